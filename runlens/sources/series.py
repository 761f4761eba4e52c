"""Metric series over an exported point table.

Expected columns: metric_type, resource_type, cluster_name or job_id, region, end_time,
double_value, int64_value, distribution_count, and the labels that tell series apart.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.fixed import (
    CLUSTER_METRIC_TYPES,
    DRIVER_RESOURCE,
    JOB_METRIC_TYPES,
    JOB_RESOURCE,
)
from runlens.functions.clock import literal_for, utc
from runlens.operators.ranking import group_numbers
from runlens.storage import pin


def _select(points, metric_types, resource, start, end) -> DataFrame:
    low, high = (literal_for(points, "end_time", m) for m in (start, end))
    return points.where(
        F.col("metric_type").isin(*metric_types)
        & (F.col("resource_type") == resource)
        & F.col("end_time").between(low, high)
    )


def cluster_metrics(
    points: DataFrame,
    start: datetime,
    end: datetime,
    *,
    region: str,
    cluster_name: str | None = None,
    metric_types: Iterable[str] | None = None,
) -> DataFrame:
    """Cluster points of all asked metric types in one pass."""
    types = tuple(metric_types or CLUSTER_METRIC_TYPES)
    rows = _select(points, types, DRIVER_RESOURCE, start, end).where(F.col("region") == region)
    return rows if cluster_name is None else rows.where(F.col("cluster_name") == cluster_name)


def job_metrics(
    points: DataFrame,
    start: datetime,
    end: datetime,
    *,
    job_id: str | None = None,
    metric_types: Iterable[str] | None = None,
) -> DataFrame:
    """Job points of all asked metric types in one pass."""
    types = tuple(metric_types or JOB_METRIC_TYPES)
    rows = _select(points, types, JOB_RESOURCE, start, end)
    return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def point_value() -> Column:
    """Double value, else integer value, else a non-zero distribution count, else 0."""
    return F.coalesce(
        F.col("double_value"),
        F.col("int64_value").cast("double"),
        F.nullif(F.col("distribution_count"), F.lit(0)).cast("double"),
        F.lit(0.0),
    )


def metric_points(points: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per point, its time as UTC."""
    return points.select(*keys, utc(points, "end_time").alias("timestamp"), point_value().alias("value"))


def metric_series(points: DataFrame, *keys: str) -> DataFrame:
    """The points of each series with ``place``, their number in the series in time order.

    One meaning at every size: a series may hold a third of all points, so it is neither
    collected into an array nor numbered in one task (``ranking.group_numbers``). Points get
    an ordinal and are written with it first, so that equal points are told apart in the same
    way whenever they are read, and may be dealt to several tasks.
    """
    told = metric_points(points, *keys).withColumn("ordinal", F.monotonically_increasing_id())
    numbered = group_numbers(pin(told), list(keys), ["timestamp", "value", "ordinal"], "place")
    return numbered.drop("ordinal")
