"""Cutting lineage in the shared folder the cluster names, and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without one gets a
    new temporary folder; a cluster must name a shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="runlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Compute once and keep the rows, with the partitioning they have now, in the
    shared folder; a lost executor then costs a re-read and no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``broadcast_rows`` rows. It is counted
    first and should be pinned; beyond the bound it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df


def local_frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A few collected rows as a local relation, which costs no job to read."""
    table = pa.Table.from_pylist([r.asDict() for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


# Rows of a hot key are parted into pieces of this share of what a task has on average.
_PIECE = 8


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``hot, pieces``: the keys that have much more rows than a piece, NULL among them, and
    how many pieces they make. They come from partial counts over the key column alone, and
    are fewer than ``_PIECE / 2`` for each shuffle partition, so they may be broadcast."""
    spark = df.sparkSession
    counted = pin(df.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("rows")))
    wanted = _PIECE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = counted.orderBy(F.desc("rows")).limit(wanted // 2)
    whole = counted.agg(F.sum("rows")).first()[0] or 0
    hot = most.select("hot", F.ceil(F.col("rows") * wanted / max(1, whole)).cast("int").alias("pieces"))
    hot = hot.where("pieces > 2")
    return local_frame(spark, hot.collect(), hot.schema)


def _salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` left-joined with a ``right`` that is unique on ``key``, by a shuffle in which
    the rows of a hot key go to many tasks and its row of ``right`` to all of these."""
    plain = (T.StringType, T.BinaryType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    told = [f.name for f in left.schema if isinstance(f.dataType, plain) and f.name != key]
    hot = hot_keys(left, key)
    if not told or not hot.count():
        return left.join(right, key, "left")
    # A row's own values choose its piece, so a task that is run again deals it out alike.
    parted = left.join(F.broadcast(hot), left[key].eqNullSafe(hot["hot"]), "left")
    piece = F.pmod(F.xxhash64(*told), F.coalesce("pieces", F.lit(1))).cast("int")
    parted = parted.withColumn("piece", piece).drop("hot", "pieces")
    copies = right.join(F.broadcast(hot), right[key] == hot["hot"], "left")
    copies = copies.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    return parted.join(copies.drop("hot", "pieces"), [key, "piece"], "left").drop("piece")


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, *, broadcast_rows: int, skewed: bool = True
) -> DataFrame:
    """``left`` left-joined with a pinned ``right`` that is unique on ``key``.

    ``left`` is planned once either way. While ``right`` is small it does not move; beyond
    that both sides are shuffled. A hot key of ``left`` is parted there, whether adaptive
    execution is on or not; ``skewed=False`` tells that ``left`` is unique on the key too.
    """
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(right), key, "left")
    return _salted(left, right, key) if skewed else left.join(right, key, "left")
