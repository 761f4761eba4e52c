"""Windowed scan of the run-state table and its ingest summary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import clock, identity
from runlens.functions import variant as V
from runlens.schema import RUN_STATE_COLUMNS


def scan_runs(
    table: DataFrame,
    start: datetime,
    end: datetime,
    *,
    ordered: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Runs started inside the closed window, or without a start time but dated in it.

    Both sides of the OR compare bare columns with literals of their own type, so
    the predicate reaches the file scan. ``ordered`` gives newest first; leave it off
    when a later step orders the rows anyway. ``keep`` adds caller columns, such as a
    unique run key.
    """
    t, d = F.col("application_start_time"), F.col("run_date")
    V.accept_repeated_keys(table.sparkSession)
    low, high = (clock.literal_for(table, "application_start_time", m) for m in (start, end))
    first, last = clock.date_literal(start.date()), clock.date_literal(end.date())
    runs = table.select(*RUN_STATE_COLUMNS, *keep).where(
        t.between(low, high) | (t.isNull() & d.between(first, last))
    )
    if not ordered:
        return runs
    return runs.orderBy(
        F.desc_nulls_last("application_start_time"), F.desc_nulls_last("application_end_time")
    )


def ingest_summary(
    runs: DataFrame, start: datetime, end: datetime, *, approximate: bool = False
) -> DataFrame:
    """Window bounds, run count and number of distinct named clusters; the latter exact,
    or by sketch where asked."""
    cluster = identity.non_empty(identity.cluster_name(F.col("dataproc_jobid")))
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return runs.agg(
        F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz").alias("window_start"),
        F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz").alias("window_end"),
        F.count("*").alias("run_count"),
        distinct(cluster).alias("distinct_clusters"),
    )
