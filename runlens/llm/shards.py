"""Contiguous shards of nearly equal bytes, by global prefix sums.

Documents are put in one global order by range partitioning of narrow rows (no text). Each
partition's total is summed, the totals are summed up once (one row per partition), and a
running sum inside the partition gives every document its place in the byte stream. The
stream is cut at equal targets. The last part of the order is a row number, so that a third
of all rows with one id, or with one text, still spreads over many partitions.

Defined cases: a null text counts one byte and has the checksum of the empty text; null ids
come first; repeated rows get places of their own; fewer documents than shards leave some
shards empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import parts, stash


def shard(
    docs: DataFrame, *, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, shard, slot``, and ``byte_start``, the bytes before it."""
    n = parts(docs.sparkSession)
    text = F.coalesce(F.col("t"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "size", "text_crc32", "row"]
    # Range bounds are sampled, so the partition numbers are written before they are used twice.
    ranged = stash(
        narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shards"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_before"),
        F.sum("b").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    # One row for each of the n partitions of the order: n is a setting and does not follow the data.
    placed = (
        ranged.repartitionByRange(n, "part")
        .withColumn("run", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("bytes_before") + F.col("run") - F.col("size")).alias("byte_start"),
            (F.col("rows_before") + F.col("nth") - 1).alias("position"),
            "all_bytes",
        )
        # The document's middle decides, so a cut falls on the nearer side of a document.
        .withColumn(
            "shard",
            F.least(
                F.lit(n_shards - 1),
                F.expr(f"(2 * byte_start + size) * {n_shards} div (2 * all_bytes)"),
            ).cast("int"),
        )
        .drop("all_bytes")
    )
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("position") - F.col("first")).alias("slot"),
        "byte_start",
    )
