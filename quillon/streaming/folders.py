"""A typed-CSV table whose files keep coming, as a stream.

The engine's queries are batch queries; this runs them on what arrives.  All files
of the folder have the header of its first, and the same tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.typed_csv import parse_header, schema_of


def stream(spark: SparkSession, folder: str, header: str, late: str | None = None, time: str | None = None) -> DataFrame:
    """Rows as they arrive; with ``time`` and ``late``, rows later than that are dropped by windowed aggregates."""
    schema = schema_of(parse_header(header))
    rows = spark.readStream.csv(folder, header=True, schema=schema, enforceSchema=True, ignoreTrailingWhiteSpace=True)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if time and late else rows


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Each batch goes to sink(rows, number); with a sink that overwrites by number, exactly once. Stops when all files are read."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
