"""Order and rank the rows of groups of any size, split over many tasks.

A window partition lives in one task, so ``row_number`` over a group with a third of all
rows would not scale. Here the whole table is range-partitioned by group and order, each
task numbers its own rows, and only one small row per (group, task) is summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.storage import bounded, local_frame, pin


def spread(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in (keys, order) with an increasing ``row_id``, pinned.

    ``keys`` and ``order`` together should tell rows apart: equal rows cannot be split.
    Pinning is needed for right results, because range bounds come from a sample and may
    differ when a plan is computed again. ``row_id`` has no gaps inside a partition.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return pin(ranged.withColumn("row_id", F.monotonically_increasing_id()))


def part() -> Column:
    """The partition a ``row_id`` was given in: its upper bits."""
    return F.shiftright(F.col("row_id"), 33)


def segments(ranged: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """One row per (keys, part): first id, weight inside, weight before, total weight.

    A group has at most one segment for each partition.
    """
    counted = ranged.groupBy(*keys, part().alias("part")).agg(
        F.min("row_id").alias("first_id"),
        F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("inside"),
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "*",
        F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("before"),
        F.sum("inside").over(group).alias("total"),
    )


def _placed(ranged: DataFrame, pieces: DataFrame, keys: list[str], broadcast_rows: int) -> DataFrame:
    """``ranged`` with its segment's columns. Segments are counted first: there is one for
    each partition a group touches, so their number can follow the data."""
    named = pieces.select(
        *(F.col(k).alias(f"piece_{k}") for k in keys), F.col("part").alias("piece_part"),
        "first_id", "before", "total",
    )
    same = F.col("piece_part") == part()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"piece_{k}"))
    joined = ranged.join(bounded(named, broadcast_rows), same, "left")
    return joined.select(*ranged.columns, "first_id", "before", "total")


def cut(
    df: DataFrame, keys: list[str], order: list[str], rows: int, *, broadcast_rows: int = 200_000
) -> tuple[DataFrame, bool]:
    """Rows in order, each group cut into blocks of at most ``rows`` rows.

    Adds ``row_id``, ``block`` and ``total``; groups of one block have block 0 and total
    NULL. Also tells whether any group has more than one block.
    """
    ranged = spread(df, keys, order)
    large = pin(segments(ranged, keys).where(F.col("total") > rows))
    if large.isEmpty():
        whole = ranged.withColumn("block", F.lit(0))
        return whole.withColumn("total", F.lit(None).cast("bigint")), False
    position = F.col("row_id") - F.col("first_id") + F.col("before")
    block = F.coalesce(F.floor(position / rows), F.lit(0)).cast("int")
    joined = _placed(ranged, large, keys, broadcast_rows).withColumn("block", block)
    return joined.select(*ranged.columns, "block", "total"), True


def group_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str, *, broadcast_rows: int = 200_000
) -> DataFrame:
    """Adds ``name``, from 1 in each group in the given order, for groups of any size."""
    ranged = spread(df, keys, order)
    placed = _placed(ranged, pin(segments(ranged, keys)), keys, broadcast_rows)
    number = F.col("row_id") - F.col("first_id") + F.col("before") + 1
    return placed.withColumn(name, number).drop("row_id", "first_id", "before", "total")


# Stretches that rows are counted in: 2**30 units, then finer ones inside the last of them.
_SHIFTS = (30, 20, 10, 0)
# So many rows more than twice those asked for are sorted rather than counted once more.
_SLACK = 65_536
_NULL_FIRST = -(1 << 62)
# One row per group, up to this number of groups, comes to the driver.
_FEW_GROUPS = 10_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"cut_{k}"])
    return same


def first_numbers(
    df: DataFrame, keys: list[str], moment: str, tie: str, n: int, name: str, *, broadcast_rows: int = 200_000
) -> tuple[DataFrame, int, int]:
    """The first ``n`` rows of each group, numbered by ``name``, and two bounds: no ``moment``
    of theirs is above the one, and they are not more than the other.

    Rows are in the order of ``moment``, a whole number, and ``tie``; a missing moment is
    first. They are not all sorted: partial counts per group and stretch of ``moment`` tell
    in which stretch the n-th row is, and that stretch is counted in finer ones while it
    holds many more. Only rows up to its end are numbered. Pin ``df`` if it is costly.
    """
    rows = df.withColumn(moment, F.coalesce(moment, F.lit(_NULL_FIRST)))
    group = keys or ["whole"]
    if not keys:
        rows = rows.withColumn("whole", F.lit(0))
    cuts = None
    for shift in _SHIFTS:
        bucket = F.shiftright(moment, shift).alias("bucket")
        if cuts is None:
            counted = rows.withColumn("taken", F.lit(0).cast("bigint"))
        else:
            last = cuts.select(*(F.col(k).alias(f"cut_{k}") for k in group), F.col("bucket").alias("last"), "taken")
            counted = rows.join(last, _same(rows, last, group)).where(
                F.shiftright(moment, wider) == F.col("last")
            )
        counted = counted.groupBy(*group, bucket).agg(F.count("*").alias("inside"), F.max("taken").alias("taken"))
        earlier = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("taken", F.col("taken") + F.coalesce(F.sum("inside").over(earlier), F.lit(0)))
        reached = placed.where(F.col("taken") < n).groupBy(*group)
        cuts = reached.agg(
            F.max("bucket").alias("bucket"),
            F.max("taken").alias("taken"),
            F.max(F.col("taken") + F.col("inside")).alias("upto"),
        )
        few = cuts.limit(_FEW_GROUPS + 1).collect()
        if len(few) <= _FEW_GROUPS:
            cuts = F.broadcast(local_frame(df.sparkSession, few, cuts.schema))
            sums = (sum(r.upto for r in few), sum(min(r.upto, n) for r in few), max((r.bucket for r in few), default=0))
        else:
            cuts = pin(cuts)
            sums = cuts.agg(F.sum("upto"), F.sum(F.least("upto", F.lit(n))), F.max("bucket")).first()
            cuts = bounded(cuts, broadcast_rows)
        held, asked, end = sums
        if held <= 2 * asked + _SLACK:
            break
        wider = shift
    last = cuts.select(*(F.col(k).alias(f"cut_{k}") for k in group), F.col("bucket").alias("last"))
    near = rows.join(last, _same(rows, last, group)).where(F.shiftright(moment, shift) <= F.col("last"))
    if held <= broadcast_rows:
        number = F.row_number().over(Window.partitionBy(*group).orderBy(moment, tie))
        numbered = near.withColumn(name, number.cast("bigint"))
    else:
        numbered = group_numbers(near.select(*rows.columns), group, [moment, tie], name, broadcast_rows=broadcast_rows)
    numbered = numbered.where(F.col(name) <= n).withColumn(moment, F.nullif(moment, F.lit(_NULL_FIRST)))
    return numbered.select(*df.columns, name), ((end + 1) << shift) - 1, held


def line_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``line_no``, from 1 in the given order, without a one-task window over the
    rows: only one count per partition is summed up."""
    ranged = spread(df, [], order).withColumn("part", part())
    sizes = ranged.groupBy("part").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "part", "first_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    number = F.col("row_id") - F.col("first_id") + F.col("before") + 1
    return (
        ranged.join(F.broadcast(starts), "part")
        .withColumn("line_no", number)
        .drop("part", "first_id", "before", "row_id")
    )


def exact_quantiles(
    rows: DataFrame, keys: list[str], value: str, ranks: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group, linear between neighbours at ``(n - 1) * rank``.

    Gives ``keys``, one column per entry of ``ranks``, and only groups with a value.
    Repeated values are counted together before anything is sorted, so neither a hot
    group nor a hot value ends up in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("n")
    )
    ranged = spread(counted, keys, [value]).withColumn("part", part())
    pieces = segments(ranged, keys, F.col("n")).select(*keys, "part", "before", "total")
    inside = Window.partitionBy(*keys, "part").orderBy("row_id")
    placed = ranged.join(pieces, [*keys, "part"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(inside)
    )
    # A value covers the 0-based positions [upto - n, upto).
    start, stop = F.col("upto") - F.col("n"), F.col("upto")

    def position(rank: float) -> Column:
        return (F.col("total") - 1) * F.lit(rank)

    def covers(at: Column) -> Column:
        return (at >= start) & (at < stop)

    wanted, picks = [], []
    for name, rank in ranks.items():
        low, high = F.floor(position(rank)), F.ceil(position(rank))
        wanted += [covers(low), covers(high)]
        picks += [
            F.max(F.when(covers(low), F.col(value))).alias(f"{name}_low"),
            F.max(F.when(covers(high), F.col(value))).alias(f"{name}_high"),
        ]
    keep = wanted[0]
    for condition in wanted[1:]:
        keep = keep | condition
    chosen = placed.where(keep).groupBy(*keys).agg(*picks, F.first("total").alias("total"))
    return chosen.select(
        *keys,
        *(
            (
                F.col(f"{name}_low")
                + (F.col(f"{name}_high") - F.col(f"{name}_low"))
                * (position(rank) - F.floor(position(rank)))
            ).alias(name)
            for name, rank in ranks.items()
        ),
    )
