from pathlib import Path

import pytest
from pyspark.sql import types as T

from quillon.sources import results, typed_csv
from quillon.sources.typed_csv import parse_header, register_folder, schema_of


def test_header_tags_in_any_order_and_untyped_columns():
    a, b, c, d = parse_header("Orders_id (N) (P),x_y (P) (D), plain ,Name (T)\r\n", "Orders", ("Orders", "Shops"))
    assert (a.name, a.tag, a.primary, a.refers_to) == ("Orders_id", "N", True, None)
    assert (b.name, b.tag, b.primary) == ("x_y", "D", True)
    assert (c.name, c.tag, c.primary) == ("plain", None, False)
    assert (d.name, d.tag) == ("Name", "T")
    assert [f.dataType for f in schema_of([a, b, c, d])] == [T.FloatType(), T.TimestampNTZType(), T.StringType(), T.StringType()]


def test_references_take_the_longest_table_name():
    (c,) = parse_header("Big_Shop_id (N)", "Sales", ("Big", "Big_Shop", "Sales"))
    assert c.refers_to == "Big_Shop"


def test_folder_reads_blanks_quotes_times_and_line_ends(spark, shop):
    folder = register_folder(spark, shop)
    rows = {r["Staff_id"]: r for r in spark.table("Staff").collect()}
    assert rows[4]["Name"] == "Day, D" and rows[4]["Joined"] is None and rows[3]["Pay"] is None
    assert str(rows[2]["Joined"]) == "2021-07-10 09:15:00" and str(rows[1]["Joined"]) == "2019-07-14 00:00:00"
    assert spark.table("Goods").filter("Title is null").count() == 1
    assert spark.table("Empty").count() == 0
    assert spark.table("Sales").schema["Sales_id"].metadata == {"tag": "N", "primary": True}
    assert folder.order.index("Goods") < folder.order.index("Sales") > folder.order.index("Staff")


def test_broken_keys_are_counted(spark, shop):
    (Path(shop) / "Goods.csv").open("a").write("\n104,Twice,1,\n,None,2,\n")
    folder = register_folder(spark, shop)
    assert folder.check_keys(spark) == {"Goods primary key": 2, "Sales.Goods_id -> Goods": 1}


def test_unparsable_numbers_are_null_or_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a (N),b (T)\nx,1\n2,2\n")
    register_folder(spark, str(tmp_path))
    assert [r["a"] for r in spark.table("t").orderBy("b").collect()] == [None, 2.0]
    register_folder(spark, str(tmp_path), mode="FAILFAST")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        spark.table("t").collect()


def test_references_in_a_circle_and_two_to_one_table(spark, tmp_path):
    (tmp_path / "A.csv").write_text("A_id (N) (P),B_id (N)\n1,1\n")
    (tmp_path / "B.csv").write_text("B_id (N) (P),A_id (N),A_other (N)\n1,1,1\n")
    assert sorted(register_folder(spark, str(tmp_path)).order) == ["A", "B"]


def test_result_rows_and_empty_results(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES ('b', 15.5F, TIMESTAMP_NTZ '2020-01-02 03:04:05', 2), ('a', CAST(NULL AS FLOAT), NULL, 1) AS t(s, x, d, n)")
    results.write_rows(df.orderBy("s"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text() == "s (T), x (N), d (D), n (N)\na, , , 1\nb, 15.5, 2020-01-02 03:04:05, 2\n"
    results.write_rows(df.filter("false"), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text() == "s (T), x (N), d (D), n (N)\n"


def test_result_folder(spark, tmp_path):
    results.write_folder(spark.range(5), str(tmp_path / "f"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "f/rows")).collect()) == list("01234")
    assert spark.read.text(str(tmp_path / "f/header")).first()[0] == "id (N)"


def test_tags_of_types(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, current_date() AS c, TRUE AS d")
    assert [typed_csv.tag_of(f) for f in df.schema] == ["N", "T", "D", "T"]


def test_aggregate_files_name_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    path = results.write_aggregate(spark.sql("SELECT avg(x) FROM VALUES (1.5F), (2.5F) AS t(x)"), None, "avg", "x", "N")
    assert path.startswith("avg_x_") and (tmp_path / path).read_text() == "avg(x (N))\n2.000000\n"


def test_results_of_joins_on_equal_names(spark, shop, tmp_path):
    from quillon.plans.engine import Engine

    engine = Engine(spark, shop)
    query = "SELECT * FROM Sales s, Staff t WHERE s.Staff_id = t.Staff_id AND s.Total > 160 ORDER BY s.Sales_id"
    engine.answer(query, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().splitlines() == [
        "Sales_id (N), Goods_id (N), Staff_id (N), Total (N), Day (D), Staff_id (N), Name (T), Pay (N), Joined (D)",
        "1, 101, 1, 250.5, 2022-06-01 00:00:00, 1, Ann, 70000.55, 2019-07-14 00:00:00",
        "2, 102, 1, 300.25, 2022-06-02 00:00:00, 1, Ann, 70000.55, 2019-07-14 00:00:00",
        "4, 106, 2, 500, 2022-06-04 00:00:00, 2, Bo, 50000.1, 2021-07-10 09:15:00",
    ]
    engine.answer(query, str(tmp_path / "f"), folder=True)
    assert spark.read.text(str(tmp_path / "f/rows")).count() == 3


def test_an_aggregate_without_rows_is_a_header(spark, shop, tmp_path):
    from quillon.plans.engine import Engine

    Engine(spark, shop).answer("SELECT avg(Pay) FROM Staff HAVING avg(Pay) > 1000000", str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text() == "avg(Pay (N))\n"


def test_quoted_text_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 'say "x"'), ("two\nlines", None)], "s string, t string")
    results.write_rows(df, str(tmp_path / "q.csv"), quoted=True)
    assert (tmp_path / "q.csv").read_text() == 's (T), t (T)\n"a, b", "say ""x"""\n"two\nlines", \n'


def test_written_tables_read_back(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, 'a, b', TIMESTAMP_NTZ '2020-01-02 03:04:05', 1.5D), (2, '', NULL, NULL) AS t(t_id, s, d, x)")
    typed_csv.write_table(df, str(tmp_path), "t", ("t_id",))
    register_folder(spark, str(tmp_path))
    a, b = spark.table("t").orderBy("t_id").collect()
    assert (a["s"], str(a["d"]), a["x"]) == ("a, b", "2020-01-02 03:04:05", 1.5) and (b["s"], b["d"], b["x"]) == (None, None, None)
    assert spark.table("t").schema["t_id"].metadata == {"tag": "N", "primary": True}


def test_command_line_writes_and_shows_once(spark, shop, tmp_path, capsys):
    from quillon.__main__ import main

    (tmp_path / "q.txt").write_text("SELECT Name, Pay FROM Staff WHERE Pay > 60000;")
    main([shop, str(tmp_path / "q.txt"), "--out", str(tmp_path / "o.csv"), "--show", "5"])
    assert capsys.readouterr().out.startswith("Name (T), Pay (N)\nAnn, 70000.55\n")
    main([shop, str(tmp_path / "q.txt"), "--out-folder", str(tmp_path / "of"), "--show", "5"])
    assert capsys.readouterr().out.startswith("Name (T), Pay (N)\nAnn, 70000.55\n")


def test_the_registry_survives_a_missing_package(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [n for n in sys.modules if n.startswith("quillon.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "numpy", None)
    with pytest.warns(UserWarning) if __import__("importlib").util.find_spec("quillon.llm") else __import__("contextlib").nullcontext():
        found = e.queries()
    assert "join_equi" in found and not any(n.startswith("op") and n[2].isdigit() for n in found)
