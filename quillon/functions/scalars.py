"""Value functions with the rules of typed CSV fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without spaces, tabs and line ends on both sides."""
    return F.btrim(c, F.lit(" \t\r\n"))


def blank_to_null(c: Column) -> Column:
    """Blank text is no value."""
    return F.when(trimmed(c) != "", c)


def to_number(c: Column) -> Column:
    """Text to FLOAT; blank, unparsable and NaN are null."""
    return F.nanvl(trimmed(c).try_cast("float"), F.lit(None).cast("float"))


def to_time(c: Column) -> Column:
    """Text to a timestamp without zone: with an unpadded hour, a date alone, or T between the two; else null."""
    return trimmed(c).try_cast("timestamp_ntz")


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def to_date(c: Column) -> Column:
    """Text to a date, of a timestamp too; unparsable text is null."""
    return to_time(c).cast("date")


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def number_literal(value: float) -> Column:
    """A literal of the type of typed-CSV numbers, so that 99.99 equals a field 99.99."""
    return F.lit(value).cast("float")
