"""Choosing the baseline of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.profile import samples
from runlens.operators.running import running_baselines
from runlens.schema import BASELINE_FIELDS
from runlens.storage import lookup_join, pin


def _packed(baselines: DataFrame, key: str, name: str) -> DataFrame:
    return baselines.select(key, F.struct(*BASELINE_FIELDS).alias(name))


def attach_history(runs: DataFrame, baselines: DataFrame, *, broadcast_rows: int) -> DataFrame:
    """Runs with the historical baseline of their family as struct ``historical``.

    ``baselines`` must be pinned; the join strategy follows its counted size.
    """
    return lookup_join(
        runs, _packed(baselines, "job_id", "historical"), "job_id", broadcast_rows=broadcast_rows
    )


def cold_samples(profiled: DataFrame, baselines: DataFrame, *, broadcast_rows: int) -> DataFrame:
    """Samples of families without history. Only these need a running baseline, which
    keeps most rows out of its sort once history has built up."""
    known = baselines.select("job_id", F.lit(True).alias("known"))
    joined = lookup_join(samples(profiled), known, "job_id", broadcast_rows=broadcast_rows)
    return joined.where(F.col("known").isNull()).drop("known")


def cold_baselines(
    profiled: DataFrame, baselines: DataFrame, *, block_rows: int, broadcast_rows: int
) -> DataFrame:
    """Running baselines of the runs whose family has no history, pinned."""
    cold = pin(cold_samples(profiled, baselines, broadcast_rows=broadcast_rows))
    return pin(running_baselines(cold, block_rows=block_rows))


def resolve_baselines(
    profiled: DataFrame, baselines: DataFrame, running: DataFrame, *, broadcast_rows: int
) -> DataFrame:
    """Adds ``baseline`` and ``baseline_source``: the whole historical row if the family
    has one, else the whole running row, else NULL; never a mix of the two.

    Both lookups are pinned. The rows of ``profiled`` are read once; they do not move while
    a lookup fits a broadcast, and move once for each lookup that does not.
    """
    with_history = attach_history(profiled, baselines, broadcast_rows=broadcast_rows)
    both = lookup_join(
        with_history, _packed(running, "uid", "running"), "uid", broadcast_rows=broadcast_rows, skewed=False
    )
    historical, local = F.col("historical"), F.col("running")
    return both.withColumns(
        {
            "baseline": F.when(historical.isNotNull(), historical).otherwise(local),
            "baseline_source": F.when(historical.isNotNull(), F.lit("history"))
            .when(local.isNotNull(), F.lit("batch"))
            .otherwise(F.lit("none")),
        }
    ).drop("historical", "running")
