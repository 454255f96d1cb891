"""CSV tables whose header declares types and keys: ``Price (N)``, ``Orders_id (N) (P)``.

Tags: N number (float), T text, D timestamp without zone, P primary key; a column
without a type is text.  ``<Table>_...`` in another table refers to the column of the same
name of that table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header tags and their types.
TYPES = {"N": T.FloatType(), "T": T.StringType(), "D": T.TimestampNTZType()}

_TAG = re.compile(r"\s*\(([NTDP])\)")


@dataclass(frozen=True)
class Column:
    name: str
    tag: str | None  # N, T or D
    primary: bool = False
    refers_to: str | None = None  # a table with a column of the same name


def parse_header(line: str, table: str = "", tables: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a header line; tags may stand in any order."""
    found = []
    for raw in line.rstrip("\r\n").split(","):
        tags = _TAG.findall(raw)
        name = _TAG.sub("", raw).strip()
        # the longest table name that fits, so that table names may hold "_"
        owner = max((t for t in tables if t != table and name.lower().startswith(t.lower() + "_")), key=len, default=None)
        found.append(Column(name, next((t for t in tags if t != "P"), None), "P" in tags, owner))
    return found


def schema_of(columns: list[Column]) -> T.StructType:
    fields = []
    for c in columns:
        keys = {"tag": c.tag or "T"} | ({"primary": True} if c.primary else {}) | ({"refers_to": c.refers_to} if c.refers_to else {})
        fields.append(T.StructField(c.name, TYPES.get(c.tag, T.StringType()), True, keys))
    return T.StructType(fields)


def tag_of(field: T.StructField) -> str:
    """The tag to show for a result column."""
    if isinstance(field.dataType, T.NumericType):
        return "N"
    return "D" if isinstance(field.dataType, T.TimestampNTZType | T.TimestampType | T.DateType) else "T"


def _files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Stem and path of the CSV files of a folder, by Hadoop's file systems, so any store will do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [str(s.getPath().toString()) for s in fs.listStatus(path) if s.getPath().getName().lower().endswith(".csv")]
    return {n.rsplit("/", 1)[-1][:-4]: n for n in sorted(names)}


def read_table(spark: SparkSession, path: str, columns: list[Column], mode: str = "PERMISSIVE") -> DataFrame:
    """Blank fields are null; unparsable ones too, or an error with mode FAILFAST."""
    schema = schema_of(columns)
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, ignoreTrailingWhiteSpace=True, mode=mode)
    # the reader drops metadata, which holds tags and keys
    return rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema))


def write_table(df: DataFrame, folder: str, table: str, primary: tuple[str, ...] = ()) -> None:
    """df as the typed table ``<folder>/<table>.csv``, a folder of part files that each have the header."""
    named = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        shown = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if tag_of(f) == "D" else c
        named.append(shown.alias(f"{f.name} ({tag_of(f)})" + (" (P)" if f.name in primary else "")))
    df.select(*named).write.csv(f"{folder}/{table}.csv", header=True, emptyValue="", mode="overwrite")


@dataclass
class Folder:
    """The tables of a folder, registered as views."""

    columns: dict[str, list[Column]]
    order: list[str]

    def check_keys(self, spark: SparkSession) -> dict[str, int]:
        """Violations: rows of repeated or null primary keys, and rows that refer to nothing, where there are any."""
        found = {}
        for table, columns in self.columns.items():
            key = [F.col(f"`{c.name}`") for c in columns if c.primary]
            if key:
                twice = spark.table(f"`{table}`").groupBy(*key).agg(F.count("*").alias("n"))
                empty = F.lit(False)
                for k in key:
                    empty = empty | k.isNull()
                bad = twice.agg(F.sum(F.when(empty, F.col("n")).otherwise(F.col("n") - 1)).alias("n")).first()["n"]
                if bad:
                    found[f"{table} primary key"] = bad
            for c in columns:
                if c.refers_to and any(p.name == c.name for p in self.columns[c.refers_to]):
                    child = spark.table(f"`{table}`").select(f"`{c.name}`").filter(F.col(f"`{c.name}`").isNotNull())
                    if bad := child.join(spark.table(f"`{c.refers_to}`"), c.name, "left_anti").count():
                        found[f"{table}.{c.name} -> {c.refers_to}"] = bad
        return found


def register_folder(spark: SparkSession, folder: str, mode: str = "PERMISSIVE") -> Folder:
    """Every CSV file of the folder becomes the view named by its stem."""
    files = _files(spark, folder)
    headers = {t: (spark.read.text(p).limit(1).collect() or [[""]])[0][0] for t, p in files.items()}
    columns = {t: parse_header(h, t, tuple(files)) for t, h in headers.items()}
    for table, path in files.items():
        read_table(spark, path, columns[table], mode).createOrReplaceTempView(f"`{table}`")
    parents = {t: {c.refers_to for c in cs if c.refers_to} for t, cs in columns.items()}
    try:
        order = list(TopologicalSorter(parents).static_order())
    except CycleError:
        order = list(columns)  # views need no order
    return Folder(columns, order)
