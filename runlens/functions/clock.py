"""UTC time handling. Inside the engine a timestamp is TIMESTAMP_NTZ holding UTC,
so no result depends on the session time zone."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.params import naive_utc


def ntz_literal(moment: datetime) -> Column:
    return F.lit(naive_utc(moment).isoformat(sep=" ")).cast("timestamp_ntz")


def literal_for(df: DataFrame, column: str, moment: datetime) -> Column:
    """A literal of the column's own type, so that the comparison needs no cast on
    the column and reaches the file scan."""
    if isinstance(kind_of(df, column), T.TimestampType):
        return F.lit(naive_utc(moment).isoformat(sep=" ") + "+00:00").cast("timestamp")
    return ntz_literal(moment)


def date_literal(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def instant_utc(instant: Column) -> Column:
    """A TIMESTAMP as UTC TIMESTAMP_NTZ. Counting from the epoch never passes through local
    time, which a repeated hour would not tell apart."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def as_utc(c: Column, kind: T.DataType) -> Column:
    """A value of this type as UTC TIMESTAMP_NTZ; zone-less values count as UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return c
    if isinstance(kind, T.StringType):
        zoned = c.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$") & c.contains(":")
        return F.when(zoned, instant_utc(F.try_to_timestamp(c))).otherwise(c.try_cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampType):
        return instant_utc(c)
    return c.cast("timestamp_ntz")


def kind_of(df: DataFrame, path: str) -> T.DataType:
    """Type of a nested field; arrays are looked into."""
    kind: T.DataType = df.schema
    for name in path.split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        kind = kind[name].dataType
    return kind


def utc(df: DataFrame, path: str) -> Column:
    """The column or struct field as UTC TIMESTAMP_NTZ."""
    return as_utc(F.col(path), kind_of(df, path))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with offset; the fraction appears only when it is not zero."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, never below zero; NULL if either is missing.

    The guard is needed: ``greatest`` skips NULL and would answer zero.
    """
    seconds = F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(seconds, F.lit(0.0)))


def order_columns(start: Column, end: Column, run_date: Column) -> list[Column]:
    """Processing order as typed columns: start, else end, else date, else nothing;
    then end, else date, else nothing.

    A bare date sorts before every time of that day, and a missing value first.
    Text comparison of the ISO forms gives the same order.
    """
    day = run_date.cast("timestamp_ntz")
    return [
        F.coalesce(start, end, day).alias("o1"),
        (start.isNotNull() | end.isNotNull()).cast("int").alias("o1_timed"),
        F.coalesce(end, day).alias("o2"),
        end.isNotNull().cast("int").alias("o2_timed"),
    ]


ORDER = ("o1", "o1_timed", "o2", "o2_timed", "run_identifier", "uid")
