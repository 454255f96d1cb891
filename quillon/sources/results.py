"""Result files: a header with type tags, ", " between fields.

Columns go by place, so names may recur, as they do in a join on a key that bears its parent's name.
Text is written as it is; with ``quoted``, fields that hold a comma, a quote or a line end stand in
quotes (quotes inside twice), so that the file can be read back.  Numbers are written in full (shortest form that reads back), nulls as nothing; the
result of a single ungrouped aggregate has the header ``avg(Salary (N))`` and six decimals.
"""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.typed_csv import tag_of

TIME = "yyyy-MM-dd HH:mm:ss"


def header(df: DataFrame) -> str:
    return ", ".join(f"{f.name} ({f.metadata.get('tag') or tag_of(f)})" for f in df.schema)


def _shown(field: T.StructField, quoted: bool) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.TimestampNTZType | T.TimestampType):
        return F.date_format(c, TIME)
    if isinstance(field.dataType, T.FloatType | T.DoubleType):
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    c = c.cast("string")
    return F.when(c.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) if quoted else c


def lines(df: DataFrame, quoted: bool = False) -> DataFrame:
    """One column, ``line``."""
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return df.select(F.concat_ws(", ", *(F.coalesce(_shown(f, quoted), F.lit("")) for f in df.schema)).alias("line"))


def write_rows(df: DataFrame, path: str, quoted: bool = False) -> None:
    """A local file in the order of df; rows stream through the driver. An empty result is a header."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(header(df) + "\n")
        for row in lines(df, quoted).toLocalIterator(prefetchPartitions=True):
            out.write(row[0] + "\n")


def write_folder(df: DataFrame, path: str, quoted: bool = False) -> None:
    """Part files of lines in a folder of any store, with the header beside them: for results that no one machine should hold."""
    lines(df, quoted).write.mode("overwrite").text(f"{path}/rows")
    df.sparkSession.createDataFrame([(header(df),)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_aggregate(df: DataFrame, path: str | None, function: str, column: str, tag: str) -> str:
    """The one value of df, or the header alone if there is none; without a path the file is named after function, column and time. Returns the path."""
    path = path or f"{function}_{column}_{time.strftime('%Y%m%d_%H%M%S')}.csv"
    row = df.first()
    if row is None:
        Path(path).write_text(f"{function}({column} ({tag}))\n", encoding="utf-8")
        return path
    (value,) = row
    if value is None:
        shown = ""
    elif function == "count":
        shown = str(value)
    elif isinstance(value, int | float):
        shown = f"{value:.6f}"
    elif hasattr(value, "strftime"):
        shown = value.strftime("%Y-%m-%d %H:%M:%S")
    else:
        shown = str(value)
    Path(path).write_text(f"{function}({column} ({tag}))\n{shown}\n", encoding="utf-8")
    return path
