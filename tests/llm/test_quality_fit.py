"""The forest and its threshold come from all labelled rows."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality_rules as Q


def test_bad_rows_count_wherever_their_ids_hash(spark, documents, prose):
    n = 8300
    last = {r["id"] for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(40).collect()}  # beyond the first 8,192
    plain, junk = [prose(52 + i, i) for i in range(20)], [prose(60 + i, 90 + i).replace(" ", " | ") for i in range(20)]
    docs = documents([(junk if i in last else plain)[i % 20] for i in range(n)])
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (~F.col("id").isin(*last)).cast("int").alias("quality"))
    assert {r["doc_id"] for r in Q.quality_rules(docs, labels).filter("NOT kept").collect()} == last


def test_tasks_fit_the_forest_of_all_rows(spark, documents, prose):
    texts = [prose(55 + i, i).replace("e", "E" if i % 3 else "e").replace(" ", " * " if i % 7 == 0 else " ") for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(150)] + [(8, 0)], "doc_id long, quality int")
    stats = Q.rule_statistics(documents(texts).repartition(5))
    forest, threshold = Q.fit(stats, labels)
    rows = stats.filter("NOT base_failed").toPandas()
    x, good = rows[[f"r_{r}" for r in Q.RATIOS]].to_numpy(float), ((rows["doc_id"] % 7 > 0) & (rows["doc_id"] != 8)).to_numpy()
    want = Q.grow(x[good], x.min(axis=0), x.max(axis=0))
    for part in ("feature", "value", "left", "right"):
        assert np.array_equal(getattr(forest, part), getattr(want, part))
    assert threshold == Q.calibrate(want.score(x), good)


def test_weighed_trees_hold_the_paths_of_the_rows():
    rng = np.random.default_rng(3)
    x = rng.random((300, 2)) ** 3
    drawn = Q.draw(x.min(axis=0), x.max(axis=0), trees=4, depth=6)
    forest = Q.weigh(drawn, drawn.counts(x))
    for t in range(4):
        path = []
        for row in x:
            inside, node, level = np.ones(len(x), bool), 0, 0
            while drawn.feature[t, node] >= 0 and inside.sum() > 1:
                f, v = drawn.feature[t, node], drawn.value[t, node]
                inside &= (x[:, f] < v) == (row[f] < v)
                node, level = 2 * node + 1 + int(row[f] >= v), level + 1
            path.append(level + float(Q.expected_path(int(inside.sum()))))
        leaf = list(forest.leaves(x))[t]
        assert np.allclose(forest.value[t][leaf], path)


def test_thresholds_of_repeated_scores():
    score, good, times = np.array([0.1, 0.2, 0.3, 0.4]), np.array([True, True, False, False]), np.array([5, 3, 2, 4])
    assert Q.calibrate(score, good, times) == Q.calibrate(np.repeat(score, times), np.repeat(good, times)) == 0.25
