"""Bounded samples of labelled rows, which classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int, where: Column | None = None) -> DataFrame:
    """At most ``most`` labelled documents (doc_id, text, target): those of least hashed id.

    The bound holds for the labels, so the broadcast table of ids is bounded
    too; it is not a share of the input.  A label that is null is none; of
    several labels of a document the least counts, of several texts of an id that of least hash.
    """
    known = labels.select("doc_id", target).filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.filter(where)
    known = known.groupBy("doc_id").agg(F.min(target).alias(target))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    text = F.struct(F.sha2(F.col("text").cast("string"), 256).alias("hash"), "text")
    return rows.groupBy("doc_id").agg(F.min(text).alias("one"), F.first(target).alias(target)).select("doc_id", F.col("one.text").alias("text"), target)
