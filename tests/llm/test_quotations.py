import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.llm import quotations as Q

SCHEMA = "conv_id long, turn long, role string, text string, place string, level int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def same_as_sql(df):
    c = duckdb.connect()
    c.register("given", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    c.execute("CREATE TABLE conversations AS SELECT conv_id, turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM given")
    found = Q.quotation_linking(df)
    wanted = c.sql(Q.SQL)
    cell = lambda v: None if v is None or v is pd.NA or v != v else v
    assert found.columns == wanted.columns
    assert sorted(map(str, (tuple(map(cell, r)) for r in found.collect()))) == sorted(map(str, (tuple(map(cell, r)) for r in wanted.fetchall())))
    return found


def test_threads_and_levels(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you?"),
        (1, 1, "assistant", "On Monday, user wrote:\n> Hello  THERE!\n\nFine."),
        (1, 2, "user", "> > hello there\n> Fine.\nOK good\n\n"),
        (1, 3, "assistant", "something new"),
        (1, 4, "user", " >>OK good\nreply to 2"),
        (1, 5, "user", "> something new\nreply to 3"),
        (1, 6, "user", "wrote:\nno quote after it"),
        (2, 0, None, "> Hello there\nof another conversation"),
    ]
    found = {(r["conv_id"], r["turn"]): r for r in same_as_sql(table(spark, rows)).collect()}
    assert {t: r["parent_turn"] for (c, t), r in found.items() if c == 1} == {0: None, 1: 0, 2: 1, 3: None, 4: 2, 5: 3, 6: None}
    assert sorted((r["place"], t) for (c, t), r in found.items() if c == 1) == [(0, 0), (1, 1), (2, 2), (3, 4), (4, 3), (5, 5), (6, 6)]
    assert found[1, 1]["content"] == "Fine." and found[1, 6]["content"] == "wrote:\nno quote after it"
    assert (found[1, 2]["n_quoted"], found[1, 2]["n_linked"]) == (2, 2) and found[2, 0]["n_linked"] == 0
    assert found[2, 0]["chat"] == "<||>\nof another conversation<|end|>\n"


@pytest.mark.parametrize("seed", range(4))
def test_any_conversations(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in range(6):
        said: list[str] = []
        for t in range(r.randrange(1, 14)):
            lines = [f"{r.choice('abcdef')} line {r.randrange(6)}" for _ in range(r.randrange(4))]
            for _ in range(r.randrange(3)):
                if said:
                    lines.insert(r.randrange(len(lines) + 1), r.choice([">", "> ", ">>", "> > "]) + r.choice(said))
            said += [x for x in lines if not x.startswith(">")]
            rows.append((r.choice([c, c, None]), r.choice([t, t, t, max(t - 1, 0), None]), r.choice(["user", "assistant"]), r.choice(["\n".join(lines)] * 9 + [None])))
    same_as_sql(table(spark, rows))


def test_one_conversation_holds_most_rows(spark):
    """Its passages and places are dealt over ranges, also where one line stands in every message."""
    r = random.Random(5)
    rows, said = [], []
    for t in range(1500):
        own = [f"line {t}", "yes"]
        rows.append((1, 10**12 * r.randrange(3) + t, "user", "\n".join([f"> {r.choice(said)}", "> yes", *own] if said else own)))
        said += own
    rows += [(c, t, "user", "> yes\nyes") for c in (None, 2, 3) for t in range(40)]
    found = same_as_sql(table(spark, rows))
    assert found.filter("conv_id = 1 and n_linked > 0").count() > 1000
    parted = Q._running(found.select("conv_id", "turn", F.lit(1).cast("long").alias("n")), ["conv_id"], ["turn"], Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1), "n", F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "test")
    places = sorted((x["conv_id"] or 0, x["turn"], x["n"]) for x in parted.collect())
    assert [n for c, _, n in places if c == 1] == list(range(1500)) and [n for c, _, n in places if c == 0] == list(range(40))


def test_empty_table_and_long_chain(spark):
    assert Q.quotation_linking(table(spark, [])).count() == 0
    rows = [(7, i, "user", f"message {i}" if not i else f"> message {i - 1}\nmessage {i}") for i in range(70)]
    found = Q.quotation_linking(table(spark, rows))
    assert {r["root_turn"] for r in found.collect()} == {0}
    parts = Q.segments(found, 16).orderBy("segment", "part").collect()
    assert [p["n_messages"] for p in parts] == [16, 16, 16, 16, 6]
    assert "".join(p["chat"] for p in parts) == "".join(f"<|user|>\nmessage {i}<|end|>\n" for i in range(70))


def test_no_python_in_the_plan(spark):
    plan = Q.quotation_linking(table(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
