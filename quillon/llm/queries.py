"""The llm operators as queries over whole tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import table

_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless the session says otherwise."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.suffix_dedup import suffix_dedup

    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import label_domains, mix
    from quillon.llm.packing import vocabulary

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = mix(docs.select("doc_id", "text"), label_domains(labels), {"clean": 0.9, "toxic": 0.04, "junk": 0.06}, path=vocabulary())
    p = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(("clean", "toxic", "junk"))]
    return found.select("doc_id", "tokens", *p, "rate", "copies")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quotations import quotation_linking

    return quotation_linking(table(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.html_extraction import html_extraction

    return html_extraction(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.ftrl import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}

    def prepared(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return f(spark, sf_dir)

        return run

    return {name: prepared(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    from quillon.llm import quotations, suffix_dedup

    return {"op2_suffix_dedup": suffix_dedup.SQL, "op5_quotation_linking": quotations.SQL}
