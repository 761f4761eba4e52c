"""Running baselines: each run against the earlier runs of its family in the batch.

The plain form is a window frame over all earlier rows with exact ``percentile``. It
re-sorts the growing frame for every row and keeps a family in one task, so a family
with many runs does not finish. The form here gives the same numbers:

1. Families with no more than ``block_rows`` runs, nearly all, are brought together by one
   exchange and sorted in their partition. Larger ones are put in (family, order) with
   ``ranking.spread`` and cut into blocks of ``block_rows`` rows, which are dealt out.
2. A block is swept once. Its running quantiles are order statistics of its prefixes, found
   for all rows together by one NumPy pass per bit of their ranks (``sweep.py``). It is the
   only Python code, over Arrow batches of a partition, and holds few blocks at a time.
3. The sweep of a later block must start from everything before it. Counts, sums and
   the last cluster come from one summary row per block. Of the earlier values it needs
   only those a quantile can move to while the block is read: at most ``block_rows``
   ranks to each side. The sorted values of the family are cut into buckets. Which buckets
   are in reach is found by going down a tree over them, ``FAN`` children at a time: a block
   asks only for the earlier values below the children of the node it has come to, so it
   gets a fixed number of counts at each level, and all blocks together as many as there
   are blocks times levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.clock import ORDER
from runlens.operators.profile import MEASURES, has_measure
from runlens.operators.ranking import cut
from runlens.operators.sweep import AVERAGES, BUCKET, RUN, SLICES, SUMMARY, sweep
from runlens.schema import BASELINE_SCHEMA
from runlens.storage import bounded, pin

# Bucket fetches answered by one task of the bucket join.
_TARGETS_PER_TASK = 64
# Children of a node of the tree over a family's buckets.
FAN = 16
# Large families (one per ``block_rows`` rows at most) up to this number are broadcast.
BROADCAST_FAMILIES = 200_000


_ORDER_TYPES = {
    "o1": "timestamp_ntz",
    "o1_timed": "int",
    "o2": "timestamp_ntz",
    "o2_timed": "int",
    "run_identifier": "string",
    "uid": "string",
}


def running_baselines(samples: DataFrame, *, block_rows: int = 65_536) -> DataFrame:
    """A baseline row for each run that has an earlier sample in its family.

    ``samples`` comes from ``profile.samples``; pin it first if it is costly, since families
    are counted before they are brought together. Families named '' get no running baseline.
    """
    stream = block_stream(samples, block_rows)
    swept = (
        stream.repartition("job_id", "block")
        .sortWithinPartitions("job_id", "block", "kind", "at", *ORDER)
        .select(*(c for c in stream.columns if c == "uid" or c not in ORDER))
        .mapInArrow(sweep, _SWEPT)
    )
    return swept.withColumn("job_type", F.lit("SPARK")).select("uid", *BASELINE_SCHEMA.names)


def block_stream(samples: DataFrame, block_rows: int) -> DataFrame:
    """The input of the sweep: the runs with their block, and for later blocks of large
    families one summary row and the value rows in reach.

    The runs of small families are block 0, in their own order; those of large families have
    been put in order and are numbered by ``at``."""
    named = samples.where(F.col("job_id") != "")
    sizes = named.groupBy("job_id").agg(F.count("*").alias("total")).where(F.col("total") > block_rows)
    large = pin(sizes.select("job_id"))
    if large.isEmpty():
        return named.select(*_as_run(F.lit(0), F.lit(0)))
    large = bounded(large, BROADCAST_FAMILIES)
    small = named.join(large, "job_id", "left_anti").select(*_as_run(F.lit(0), F.lit(0)))
    big, _ = cut(named.join(large, "job_id", "left_semi"), ["job_id"], list(ORDER), block_rows)
    runs = small.unionByName(big.select(*_as_run(F.col("block"), F.col("row_id"))))
    return runs.unionByName(_block_starts(big)).unionByName(_values_in_reach(big, block_rows))


def _as_run(block: Column, at: Column) -> list:
    return [
        "job_id",
        block.cast("int").alias("block"),
        F.lit(RUN).alias("kind"),
        at.cast("bigint").alias("at"),
        *(F.col(c).cast(_ORDER_TYPES[c]).alias(c) for c in ORDER),
        "cluster_name",
        *MEASURES,
        F.lit(None).cast("array<double>").alias("numbers"),
    ]


def _note(kind: int, at: Column, cluster: Column, numbers: Column) -> list:
    """A row that tells the sweep about earlier blocks."""
    return [
        "job_id",
        F.col("block").cast("int").alias("block"),
        F.lit(kind).alias("kind"),
        at.cast("bigint").alias("at"),
        *(F.lit(None).cast(_ORDER_TYPES[c]).alias(c) for c in ORDER),
        cluster.alias("cluster_name"),
        *(F.lit(None).cast("double").alias(m) for m in MEASURES),
        numbers.cast("array<double>").alias("numbers"),
    ]


def _block_starts(big: DataFrame) -> DataFrame:
    """For each later block: sample count, counts and sums, last cluster before it."""
    counted = has_measure()
    blocks = big.groupBy("job_id", "block").agg(
        F.count(F.when(counted, F.lit(1))).alias("samples"),
        *(F.count(m).alias(f"n_{m}") for m in MEASURES),
        *(F.sum(m).alias(f"s_{m}") for m in MEASURES),
        F.max(F.when(counted, F.struct("row_id", "cluster_name"))).alias("newest"),
    )
    w = Window.partitionBy("job_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbers = F.array(
        *(
            F.coalesce(F.sum(c).over(w).cast("double"), F.lit(0.0))
            for c in ["samples", *(f"n_{m}" for m in MEASURES), *(f"s_{m}" for m in MEASURES)]
        )
    )
    return blocks.select(
        "job_id",
        "block",
        numbers.alias("numbers"),
        F.last(F.col("newest")["cluster_name"], ignorenulls=True).over(w).alias("cluster"),
    ).where(F.col("block") > 0).select(
        *_note(SUMMARY, F.lit(0), F.col("cluster"), F.col("numbers"))
    )


def _values_in_reach(big: DataFrame, block_rows: int) -> DataFrame:
    """For each later block and quantile: the earlier values the quantile can reach."""
    measures = list(dict.fromkeys(m for _, m, _ in SLICES))
    runs = big.select("job_id", F.col("block").alias("source"), F.col("row_id").alias("at"), *measures)
    long = runs.unpivot(["job_id", "source", "at"], measures, "measure", "value")
    group = ["job_id", "measure"]
    # Equal values are told apart by the row, so buckets never exceed block_rows.
    ranged, _ = cut(long.where(F.col("value").isNotNull()), group, ["value", "at"], block_rows)
    ranged = ranged.withColumn("bucket", F.col("block").cast("bigint")).drop("row_id", "block", "total")
    wanted = _buckets_in_reach(ranged, runs.select("job_id", F.col("source").alias("block")).distinct(), block_rows)
    # A median bucket is wanted by nearly every block, so its fetches are dealt out.
    bucket = [*group, "bucket"]
    turn = F.row_number().over(Window.partitionBy(*bucket).orderBy("block", "slice"))
    dealt = wanted.withColumn("deal", F.floor((turn - 1) / _TARGETS_PER_TASK).cast("int"))
    deals = dealt.groupBy(*bucket).agg(F.max("deal").alias("last"))
    held_values = (
        ranged.groupBy(*bucket)
        .agg(F.collect_list(F.struct("value", "source")).alias("held"))
        .join(deals, bucket)
        .withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("last"))))
    )
    fetched = dealt.join(held_values, [*bucket, "deal"])
    earlier = F.transform(
        F.filter("held", lambda e: e["source"] < F.col("block")), lambda e: e["value"]
    )
    numbers = F.concat(
        F.array(F.col("slice").cast("double"), F.col("below").cast("double")), F.col("earlier")
    )
    # Many buckets that an early block asks for hold later values only. One at least has
    # earlier values, and each tells ``below``.
    told = fetched.withColumn("earlier", earlier).where(F.size("earlier") > 0)
    return told.select(
        *_note(BUCKET, F.col("slice"), F.lit(None).cast("string"), numbers)
    )


def _buckets_in_reach(ranged: DataFrame, blocks: DataFrame, block_rows: int) -> DataFrame:
    """``job_id, measure, slice, block, bucket, below``: the buckets whose earlier values a
    quantile can move to, and how many earlier values are below the first of them."""
    group = ["job_id", "measure"]
    cells = pin(ranged.groupBy(*group, "bucket", F.col("source").alias("block")).agg(F.count("*").alias("n")))
    slices = F.array(
        *(
            F.struct(F.lit(i).alias("slice"), F.lit(m).alias("of"), F.lit(rank).alias("rank"))
            for i, (_, m, rank) in enumerate(SLICES)
        )
    )
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A block without values of its own still needs the earlier ones.
    sizes = (
        blocks.join(cells.select(*group).distinct(), "job_id")
        .join(cells.groupBy(*group, "block").agg(F.sum("n").alias("n")), [*group, "block"], "left")
        .withColumn("size", F.sum("n").over(before))
        .where("size > 0")
    )
    lowest = F.floor((F.col("size") - 1) * F.col("s.rank")) - block_rows - 1
    highest = F.ceil((F.col("size") + block_rows) * F.col("s.rank")) + 1
    asked = (
        sizes.withColumn("s", F.explode(F.filter(slices, lambda s: s["of"] == F.col("measure"))))
        .select(
            *group, "block", F.col("s.slice").alias("slice"),
            F.explode(F.array(F.greatest(lowest, F.lit(0)), F.least(highest, F.col("size") - 1))).alias("rank"),
        )
        .withColumns({"node": F.lit(0).cast("bigint"), "below": F.lit(0).cast("bigint")})
    )
    levels, buckets = 1, (cells.agg(F.max("bucket")).first()[0] or 0) + 1
    while FAN**levels < buckets:
        levels += 1
    for level in range(levels - 1, -1, -1):
        asked = pin(_one_level_down(asked, cells, FAN**level))
    reach = asked.groupBy(*group, "block", "slice").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.min("below").alias("below")
    )
    return reach.select(
        *group, "block", "slice", "below", F.explode(F.sequence("first", "last")).alias("bucket")
    )


def _one_level_down(asked: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """Each ``asked`` row moved to the child of its ``node`` that holds its ``rank`` among the
    values of earlier blocks, with the count ``below`` that child. Children are ``width``
    buckets wide. Only cells of nodes that are asked for are counted."""
    place = ["job_id", "measure", "node"]
    child = F.floor(F.col("bucket") / width)
    counts = [f"n{d}" for d in range(FAN)]
    inside = cells.withColumns({"node": F.floor(child / FAN), "child": child % FAN}).join(
        asked.select(*place).distinct(), place, "left_semi"
    )
    held = inside.groupBy(*place, "block").agg(
        *(F.sum(F.when(F.col("child") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in range(FAN))
    )
    marks = asked.select(*place, "block").distinct()
    earlier = Window.partitionBy(*place).orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    marked = (
        held.withColumn("mark", F.lit(False))
        .unionByName(marks.select("*", *(F.lit(0).cast("bigint").alias(c) for c in counts), F.lit(True).alias("mark")))
        .select(*place, "block", "mark", *(F.sum(c).over(earlier).alias(c) for c in counts))
        .where("mark")
        .select(*place, "block", F.array(*(F.coalesce(c, F.lit(0)) for c in counts)).alias("held"))
    )
    # Running sums over the children; the first one that goes past the rank has it.
    sums = F.transform(
        F.sequence(F.lit(1), F.lit(FAN)),
        lambda k: F.col("below") + F.aggregate(F.slice("held", F.lit(1), k), F.lit(0).cast("bigint"), lambda a, b: a + b),
    )
    summed = asked.join(marked, [*place, "block"]).withColumn("sums", sums)
    at = F.size(F.filter("sums", lambda s: s <= F.col("rank"))).cast("bigint")
    return summed.withColumn("at", at).select(
        "job_id", "measure", "block", "slice", "rank",
        (F.col("node") * FAN + F.col("at")).alias("node"),
        F.when(F.col("at") > 0, F.element_at("sums", F.col("at").cast("int"))).otherwise(F.col("below")).alias("below"),
    )


_SWEPT = (
    "uid string, job_id string, cluster_name string, run_count bigint, "
    + ", ".join(f"{name} double" for name, _, _ in SLICES)
    + ", "
    + ", ".join(f"{name} double" for name, _ in AVERAGES)
)
