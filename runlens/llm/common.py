"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.storage import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there, so that
    lost executors cost a re-read and each later use reads only the columns it needs."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows; beyond that it is joined
    by a shuffle. It is counted first and should be cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def power_of_two(least: float, low: int, high: int) -> int:
    return min(high, max(low, 2 ** math.ceil(math.log2(max(1.0, least)))))
