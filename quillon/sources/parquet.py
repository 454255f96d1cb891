"""Parquet tables: one file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def register(spark: SparkSession, folder: str, *tables: str) -> None:
    """The tables as views under their names."""
    for t in tables:
        read(spark, folder, t).createOrReplaceTempView(t)
