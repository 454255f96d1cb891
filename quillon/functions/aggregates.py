"""Aggregates by name.  All skip nulls; over no rows count is 0 and the others are null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[..., Column]] = {
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "avg": F.avg,
    "count": F.count,
    "count_distinct": F.count_distinct,
    "stddev": F.stddev_samp,
    "median": F.median,
}


def aggregate(function: str, column: str | Column = "*", name: str | None = None) -> Column:
    found = AGGREGATES[function.lower()](F.lit(1) if function.lower() == "count" and isinstance(column, str) and column == "*" else column)
    return found.alias(name) if name else found
