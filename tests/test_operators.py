import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import queries
from quillon.functions import scalars as S
from quillon.functions.aggregates import aggregate
from quillon.operators import relational as R

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def canonical(frame):
    cell = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)
    return sorted(repr(tuple(cell(v) for v in row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_as_sql(spark, duck, name):
    found, wanted = queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found) == canonical(wanted)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.5, "a", "2020-01-01 00:00:00"), (2, None, "b", None), (3, -2.0, None, "2021-05-05 12:00:00"), (4, 1.5, "", "2019-12-31 23:59:59"), (None, 0.0, "B", "2020-01-01 00:00:00"), (6, 99.99, "a", "2022-02-02 02:02:02")]
    df = spark.createDataFrame(rows, "i int, x double, s string, t string").withColumn("t", F.col("t").cast("timestamp_ntz")).cache()
    c = duckdb.connect()
    frame = df.toPandas()
    c.register("raw", frame.astype({"i": "Int64"}))
    c.execute("CREATE VIEW small AS SELECT CAST(i AS INTEGER) AS i, x, s, CAST(t AS TIMESTAMP) AS t FROM (SELECT * REPLACE (CASE WHEN isnan(x) THEN NULL ELSE x END AS x) FROM raw)")
    return df, c


ATOMS = st.one_of(
    st.builds("i {} {}".format, st.sampled_from(["=", "<>", "<", ">", "<=", ">="]), st.integers(0, 5)),
    st.builds("x {} {}".format, st.sampled_from(["=", "<>", "<", ">", "<=", ">="]), st.sampled_from(["1.5", "0", "-2", "99.99"])),
    st.builds("s {} '{}'".format, st.sampled_from(["=", "<>", "<", ">=", "LIKE"]), st.sampled_from(["a", "b", "", "B"])),
    st.builds("t {} {}'2020-01-01 00:00:00'".format, st.sampled_from(["=", "<", ">="]), st.just("")),
    st.sampled_from(["s IS NULL", "x IS NOT NULL", "i IN (1, 3)", "i BETWEEN 2 AND 4", "i + 1 > x"]),
)
CONDITIONS = st.recursive(ATOMS, lambda inner: st.one_of(st.builds("({} AND {})".format, inner, inner), st.builds("({} OR {})".format, inner, inner), st.builds("NOT ({})".format, inner)), max_leaves=6)


@settings(max_examples=40, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(condition=CONDITIONS)
def test_conditions_of_any_shape(small, condition):
    df, c = small
    assert canonical(R.where(df, condition).toPandas()) == canonical(c.sql(f"SELECT * FROM small WHERE {condition}").df())


def test_nulls_join_nothing_and_sort_last(small):
    df, _ = small
    other = df.select(F.col("i").alias("j"), F.col("s").alias("r"))
    assert R.join(df, other, [("i", "j")]).count() == 5
    assert R.join(df, other, [("i", "j")], how="full").count() == 7
    for key in ("i", "i desc"):
        assert R.order(df, key).collect()[-1]["i"] is None
    assert [r["i"] for r in R.top(df, 2, "x desc", "i", offset=1).collect()] == [1, 4]


def test_broadcast_only_below_the_limit(small, monkeypatch):
    df, _ = small
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(R.join(df, df.select(F.col("i").alias("j")), [("i", "j")], small=True)).lower()
    monkeypatch.setattr(R, "BROADCAST_BYTES", 1)
    assert "strategy=broadcast" not in plan(R.join(df, df.select(F.col("i").alias("j")), [("i", "j")], small=True)).lower()


def test_aggregates_over_nulls_and_nothing(small):
    df, _ = small
    names = ["min", "max", "sum", "avg", "count", "count_distinct", "median"]
    assert tuple(df.agg(*(aggregate(n, "x") for n in names)).first()) == (-2.0, 99.99, pytest.approx(100.99), pytest.approx(20.198), 5, 4, 1.5)
    assert tuple(df.filter("false").agg(*(aggregate(n, "x") for n in names)).first()) == (None, None, None, None, 0, 0, None)


def test_scalars(spark):
    df = spark.createDataFrame([(" 1.5\r",), ("NaN",), ("",), ("x",), ("2021-07-10 9:15:00",), ("2021-07-10T09:15:00",), ("2021-07-10",), (None,)], "s string")
    rows = df.select(S.to_number(F.col("s")).alias("n"), S.time_text(S.to_time(F.col("s"))).alias("t"), S.blank_to_null(F.col("s")).alias("b")).collect()
    assert [r["n"] for r in rows] == [1.5, None, None, None, None, None, None, None]
    assert [r["t"] for r in rows][4:] == ["2021-07-10 09:15:00", "2021-07-10 09:15:00", "2021-07-10 00:00:00", None]
    assert [r["b"] for r in rows][2:4] == [None, "x"]
    dates = df.select(S.date_text(S.to_date(F.col("s"))).alias("d")).collect()
    assert [r["d"] for r in dates][4:] == ["2021-07-10", "2021-07-10", "2021-07-10", None]
    assert df.select(S.number_literal(99.99) == F.lit("99.99").cast("float")).first()[0]


def test_window_helpers(small):
    df, _ = small
    ranks = {r["i"]: r["rank"] for r in R.ranked(df.filter("i is not null"), [], "x desc", "i").collect()}
    assert ranks == {6: 1, 1: 2, 4: 3, 3: 4, 2: 5}
    assert [r["running"] for r in R.running(df.filter("i in (1, 3, 4)"), ["s"], "x", "i").orderBy("i").collect()] == [1.5, -2.0, 1.5]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(queries.queries()["sort_over_filter"](spark, DATA))
    assert "GreaterThan(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    plan = plan_of(queries.queries()["join_three_way_grouped"](spark, DATA))
    assert "GreaterThan(l_quantity" in plan and "l_comment" not in plan and "c_name" not in plan


def test_top_rows_need_no_full_sort(spark):
    plan = plan_of(queries.queries()["limit_topk"](spark, DATA))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_no_python_in_the_engine(spark):
    for name, query in queries.queries().items():
        plan = plan_of(query(spark, DATA))
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name


def test_asof_of_nulls_ties_and_many_keys(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 0, "b"), (2, 9, "c"), (None, 5, "d"), (1, None, "e")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 1, "x"), (1, 5, "y"), (1, 6, "z"), (None, 1, "n"), (3, 1, "o")], "k int, t int, w string")
    found = sorted(map(str, ((r["v"], r["r_w"]) for r in R.asof_join(left, right, ["k"], "t", ["w"], "r_").collect())))
    assert found == sorted(map(str, [("a", "y"), ("a", "y"), ("b", None), ("c", None), ("d", None), ("e", None)]))


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join_is_the_condition(spark, width):
    points = spark.createDataFrame([(i, i % 3) for i in range(-20, 40, 3)] + [(None, 0)], "p int, k int")
    spans = spark.createDataFrame([(i, i + n, i % 3) for i, n in ((-30, 15), (0, 0), (5, 30), (6, 9), (9, -4))] + [(None, 4, 0)], "a int, b int, j int")
    for by in (None, [("k", "j")]):
        want = points.join(spans, F.col("p").between(F.col("a"), F.col("b")) & (F.lit(True) if by is None else F.col("k") == F.col("j")))
        assert canonical(R.interval_join(points, spans, "p", "a", "b", width, by).toPandas()) == canonical(want.toPandas())


@pytest.mark.parametrize("at_once", [3, 100_000])
def test_exact_quantiles(spark, at_once):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(1).integers(0, 300, 500)] + [7.0] * 200
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert R.exact_quantiles(df, "x", shares, at_once) == pytest.approx(np.quantile(values, shares).tolist())
    assert R.exact_quantiles(df.filter("x < 0"), "x", [0.5]) == [None]
