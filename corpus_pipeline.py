"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read
again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, near_dedup, packing, quality_rules, suffix_dedup
from quillon.llm.queries import ready
from quillon.llm.shared import cut, table

#: Expected token totals of the mixed domains, as multiples of what is there: clean text stays, toxic and junk text is thinned out.
MIX = {"clean": 1.0, "toxic": 0.25, "junk": 0.1}


#: Bytes of a string that counts as repeated.  A passage of over 50 words has about 320; 999 of 1000 such passages of documents have 200 or more.
REPEATED = 200


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    ready(spark)
    return quality_rules.rows_kept(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    ready(spark)
    return near_dedup.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long strings go, and documents of which nothing else is left."""
    ready(spark)
    return suffix_dedup.rows_cleaned(docs, REPEATED)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    ready(spark)
    return mixing.rows_mixed(docs, mixing.label_domains(table(spark, sf_dir, "labels")), MIX, relative=True, path=packing.vocabulary())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    ready(spark)
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules),
    ("near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the forest, the alignments, the descent nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
