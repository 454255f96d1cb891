"""Connected components of a table of links, by alternating stars.

A large-star step links every greater neighbour of a node to the node's least
neighbour; a small-star step links the lesser ones.  Both are a minimum per node
and a join, so a node with very many links is a skewed join key, which adaptive
execution splits, and never a collected list.  The rounds grow with the logarithm
of the longest chain; each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b), in which a differs from b; component: the least node it is linked with.

    An empty table of links gives an empty table; repeated and reversed links change nothing.
    """
    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = cut(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct(), "links")
    state = told(edges)
    while True:
        # large star: a's neighbours on both sides
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that the join can split the partition of a node with very many links
        lowest = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node's lesser neighbours and itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = cut(small, "links")
        drop(edges, lowest)
        edges, before, state = after, state, told(after)
        if state == before:
            break
    roots = edges.groupBy("b").agg(F.first("b").alias("component")).select(F.col("b").alias("node"), "component")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
