import pytest

from quillon.__main__ import main
from quillon.plans import sql_text
from quillon.plans.engine import Engine


@pytest.mark.parametrize(
    ("sql", "out"),
    [
        ("SELECT 1; SELECT 2", "SELECT 1"),
        (" ; SELECT ';' AS a -- x;y\n; z", "SELECT ';' AS a -- x;y"),
        ("SELECT 1 /* ; */", "SELECT 1 /* ; */"),
        ("  ", ""),
    ],
)
def test_first_statement(sql, out):
    assert sql_text.first_statement(sql) == out


@pytest.mark.parametrize(
    ("sql", "out"),
    [
        ("x = 99.99 AND y > 1", "x = 99.99F AND y > 1"),
        ("x = '9.5' AND \"1.5\" < .5", "x = '9.5' AND \"1.5\" < .5F"),
        ("1e3 + 2.5D + 7L -- 1.5", "1e3F + 2.5D + 7L -- 1.5"),
        ("t1.a > 2", "t1.a > 2"),
        ("DECIMAL(10,2)", "DECIMAL(10,2)"),
    ],
)
def test_float_literals(sql, out):
    assert sql_text.float_literals(sql) == out


@pytest.mark.parametrize(
    ("sql", "out"),
    [
        ("SELECT a FROM t ORDER BY a, b DESC LIMIT 3", "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS LAST LIMIT 3"),
        ("SELECT a ORDER BY a NULLS FIRST, f(b, c)", "SELECT a ORDER BY a NULLS FIRST, f(b, c) NULLS LAST"),
        ("SELECT sum(x) OVER (PARTITION BY a, b ORDER BY c ROWS UNBOUNDED PRECEDING) FROM t", "SELECT sum(x) OVER (PARTITION BY a, b ORDER BY c NULLS LAST ROWS UNBOUNDED PRECEDING) FROM t"),
        ("SELECT * FROM (SELECT a FROM t ORDER BY (a + 1)) ORDER BY 1", "SELECT * FROM (SELECT a FROM t ORDER BY (a + 1) NULLS LAST) ORDER BY 1 NULLS LAST"),
        ("SELECT 'order by x, y' FROM t", "SELECT 'order by x, y' FROM t"),
        ("SELECT a, b FROM t GROUP BY a, b", "SELECT a, b FROM t GROUP BY a, b"),
    ],
)
def test_nulls_last(sql, out):
    assert sql_text.nulls_last(sql) == out


@pytest.mark.parametrize(
    ("sql", "out"),
    [
        ("SELECT AVG(e.Pay) AS x FROM Staff e", ("avg", "Pay")),
        ("select count( Name ) from Staff", ("count", "Name")),
        ("SELECT avg(Pay), sum(Pay) FROM Staff", None),
        ("SELECT avg(Pay) FROM Staff GROUP BY Name", None),
        ("SELECT avg(Pay + 1) FROM Staff", None),
        ("SELECT avg(Pay) FROM (SELECT Pay FROM Staff GROUP BY Pay)", ("avg", "Pay")),
    ],
)
def test_single_aggregate(sql, out):
    assert sql_text.single_aggregate(sql) == out


def test_comma_join_and_average_in_single_precision(spark, shop, tmp_path):
    engine, out = Engine(spark, shop), tmp_path / "a.csv"
    engine.answer("SELECT AVG(e.Pay) AS AveragePay FROM Staff e, Sales s WHERE e.Staff_id = s.Staff_id AND s.Total > 200", str(out))
    # FLOATs added as doubles: (70000.546875 + 70000.546875 + 50000.1015625) / 3
    assert out.read_text() == "avg(Pay (N))\n63333.731771\n"


def test_time_filter_projection_and_sort(spark, shop, tmp_path):
    out = tmp_path / "b.csv"
    Engine(spark, shop).answer("SELECT Title, Price FROM Goods WHERE Since > '2021-01-01 00:00:00' ORDER BY Price;", str(out))
    assert out.read_text() == "Title (T), Price (N)\nBolt, 15.5\n, 45.75\nLamp, 99.99\n"


def test_correlated_subquery(spark, shop):
    df = Engine(spark, shop).sql("SELECT s.Name, (SELECT SUM(Total) FROM Sales o WHERE o.Staff_id = s.Staff_id AND o.Total > 100) AS spent FROM Staff s ORDER BY spent DESC")
    assert [tuple(r) for r in df.collect()][:2] == [("Bo", 650.0), ("Ann", 550.75)]
    assert {r[0] for r in df.collect()[2:]} == {"Cy", "Day, D"}


def test_float_equality_and_null_order(spark, shop):
    engine = Engine(spark, shop)
    assert engine.sql("SELECT Title FROM Goods WHERE Price = 99.99").collect() == [("Lamp",)]
    assert engine.sql("SELECT Title FROM Goods WHERE Price >= 99.99").collect() == [("Lamp",)]
    assert engine.sql("SELECT Pay FROM Staff ORDER BY Pay").collect()[-1][0] is None
    assert engine.sql("SELECT Pay FROM Staff ORDER BY Pay DESC").collect()[-1][0] is None


def test_aggregates_of_times_text_and_nothing(spark, shop, tmp_path):
    engine, out = Engine(spark, shop), tmp_path / "x.csv"
    for sql, want in (
        ("SELECT MAX(Since) FROM Goods", "max(Since (D))\n2023-01-01 00:00:00\n"),
        ("SELECT MIN(Title) FROM Goods", "min(Title (T))\nBolt\n"),
        ("SELECT COUNT(Title) FROM Goods", "count(Title (T))\n3\n"),
        ("SELECT SUM(Empty_id) FROM Empty", "sum(Empty_id (N))\n\n"),
        ("SELECT COUNT(Empty_id) FROM Empty", "count(Empty_id (N))\n0\n"),
        ("SELECT COUNT(*) AS n, MAX(Price) AS m FROM Goods", "n (N), m (N)\n4, 99.99\n"),
    ):
        engine.answer(sql, str(out))
        assert out.read_text() == want


def test_engines_keep_their_views_apart(spark, shop, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other/Goods.csv").write_text("Goods_id (N)\n7\n")
    one, two = Engine(spark, shop), Engine(spark, str(tmp_path / "other"))
    assert one.sql("SELECT count(*) FROM Goods").first()[0] == 4
    assert two.sql("SELECT count(*) FROM Goods").first()[0] == 1


def test_no_statement(spark, shop):
    with pytest.raises(ValueError, match="no statement"):
        Engine(spark, shop).sql(" ; ")


def test_command_line(spark, shop, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "q.one.txt").write_text("SELECT Title FROM Goods WHERE Title LIKE 'L%'")
    main([shop, "q.one.txt", "--check-keys", "--show", "2"])
    assert (tmp_path / "q.csv").read_text() == "Title (T)\nLamp\n"
    assert "Sales.Goods_id -> Goods: 1 rows" in capsys.readouterr().out
