"""A folder of tables that answers SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import sql_text
from quillon.sources import parquet, results, typed_csv


class Engine:
    """Tables of one folder, as views of a session of their own.

    For typed CSV, decimal literals are FLOAT as the columns are; for Parquet they
    keep SQL's types.  Sort keys that don't say otherwise put nulls last.
    """

    def __init__(self, spark: SparkSession, folder: str, *tables: str, mode: str = "PERMISSIVE"):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.folder = None if tables else typed_csv.register_folder(self.spark, folder, mode)
        if tables:
            parquet.register(self.spark, folder, *tables)

    def prepare(self, sql: str) -> str:
        text = sql_text.nulls_last(sql_text.standard_names(sql_text.first_statement(sql)))
        return sql_text.float_literals(text) if self.folder else text

    def sql(self, sql: str) -> DataFrame:
        """The first statement of the text."""
        text = self.prepare(sql)
        if not text:
            raise ValueError("there is no statement")
        return self.spark.sql(text)

    def answer(self, sql: str, path: str, folder: bool = False, quoted: bool = False) -> DataFrame:
        """Runs the statement and writes its result file, or with ``folder`` a folder of any store, for which nothing passes through the driver."""
        df, single = self.sql(sql), sql_text.single_aggregate(sql_text.first_statement(sql))
        if folder:
            results.write_folder(df, path, quoted)
        elif single:
            results.write_aggregate(df, path, single[0], single[1], self._tag(single[1]))
        else:
            results.write_rows(df, path, quoted)
        return df

    def _tag(self, column: str) -> str:
        found = {c.name.lower(): c.tag or "T" for cs in (self.folder.columns.values() if self.folder else ()) for c in cs}
        return found.get(column.lower(), "N")
