"""Steps whose tasks must stay small on large tables."""

import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.operators import relational as R


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 16, raising=False)
    monkeypatch.setattr(R, "PAIRS_A_TASK", 500, raising=False)


@pytest.mark.parametrize("by", [None, [("k", "k")], [("k", "j")]])
def test_pairs_of_a_full_bucket_are_dealt_over_tasks(spark, small_blocks, by):
    points = spark.range(600).select(F.col("id").alias("p"), (F.col("id") % 2).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") % 10).cast("double").alias("at"))
    spans = spark.range(120).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 3).alias("j"), (F.col("id") % 12 - 6).cast("double").alias("low"), (F.col("id") % 7).cast("double").alias("high"))
    spans = spans.drop("k") if by != [("k", "k")] else spans.drop("j")
    met = R.interval_join(points, spans, "at", "low", "high", 1000.0, by)
    found = met.select("p", "id")
    inside = points["at"].between(spans["low"], spans["high"]) & (F.lit(True) if by is None else points[by[0][0]] == spans[by[0][1]])
    want = sorted(map(tuple, points.join(spans, inside).select("p", "id").collect()))
    assert sorted(map(tuple, found.collect())) == want
    assert set(met.columns) == set(points.columns) | set(spans.columns)
    a_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(a_task) > 8 and max(a_task) < len(want) / 4


def test_equal_rows_all_meet(spark, small_blocks):
    points = spark.createDataFrame([(1.0,)] * 300 + [(None,)], "at double")
    spans = spark.createDataFrame([(0.0, 5.0)] * 40 + [(None, 1.0), (3.0, 2.0)], "low double, high double")
    assert R.interval_join(points, spans, "at", "low", "high", 2.0).count() == 300 * 40
    assert R.interval_join(points.filter("at > 9"), spans, "at", "low", "high", 2.0).count() == 0


def test_no_sketch_is_kept_for_each_value(spark, tmp_path):
    rows = spark.range(3000).select((F.when(F.col("id") % 7 > 0, F.col("id") % 900)).alias("o_custkey"), "id")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    near = queries.queries()["approx_distinct"](spark, str(tmp_path))
    assert [tuple(r) for r in near.collect()] == [(True,)]
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "keys=[o_custkey" in line and "approx_count_distinct" in line]


@pytest.mark.parametrize("keys", [[], [None, None]])
def test_distinct_counts_without_values(spark, tmp_path, keys):
    spark.createDataFrame([(k,) for k in keys], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in queries.queries()["approx_distinct"](spark, str(tmp_path)).collect()] == [(True,)] * bool(keys)
