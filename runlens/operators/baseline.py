"""Historical and in-batch baselines as plain grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.clock import ORDER
from runlens.functions.identity import logical_id
from runlens.operators.profile import has_measure
from runlens.operators.ranking import exact_quantiles
from runlens.schema import BASELINE_SCHEMA

# The history's upper quantile is read at rank 18 of 20, although its columns are
# named p95; the in-batch one is the true 95th percentile.
HISTORY_UPPER_RANK = 0.9
BATCH_UPPER_RANK = 0.95
_ACCURACY = 10_000


def historical_baseline(
    history: DataFrame, *, upper_rank: float = HISTORY_UPPER_RANK
) -> DataFrame:
    """Baseline per logical id over scanned history.

    Every aggregate merges partial results, so a family with a third of all rows is
    reduced inside the scanning tasks and shuffles one buffer for each of them. The job
    type and cluster are representative values; ``min`` makes them repeatable.
    """

    def pair(c: str) -> Column:
        return F.percentile_approx(c, [0.5, upper_rank], _ACCURACY)

    grouped = (
        history.groupBy(logical_id(F.col("job_id")).alias("job_id"))
        .agg(
            F.min("job_type").alias("job_type"),
            F.min("cluster_name").alias("cluster_name"),
            pair("duration_seconds").alias("q_duration"),
            F.avg("duration_seconds").alias("avg_duration"),
            pair("app_vcore_seconds").alias("q_vcore"),
            F.avg("app_vcore_seconds").alias("avg_app_vcore_seconds"),
            pair("app_memory_gb_seconds").alias("q_memory"),
            F.avg("app_memory_gb_seconds").alias("avg_app_memory_gb_seconds"),
            F.avg("max_over_median_ratio").alias("avg_max_over_median_ratio"),
            F.percentile_approx("p95_task_duration_ms", upper_rank, _ACCURACY).alias(
                "p95_task_duration_ms"
            ),
            F.count("*").alias("run_count"),
        )
    )
    return grouped.select(
        "job_id",
        "job_type",
        "cluster_name",
        F.get("q_duration", F.lit(0)).alias("p50_duration"),
        F.get("q_duration", F.lit(1)).alias("p95_duration"),
        "avg_duration",
        F.get("q_vcore", F.lit(0)).alias("p50_app_vcore_seconds"),
        F.get("q_vcore", F.lit(1)).alias("p95_app_vcore_seconds"),
        "avg_app_vcore_seconds",
        F.get("q_memory", F.lit(0)).alias("p50_app_memory_gb_seconds"),
        F.get("q_memory", F.lit(1)).alias("p95_app_memory_gb_seconds"),
        "avg_app_memory_gb_seconds",
        "avg_max_over_median_ratio",
        "p95_task_duration_ms",
        "run_count",
    )


def exact_quantile_summary(
    rows: DataFrame, key: str, value: str, ranks: dict[str, float]
) -> DataFrame:
    """Exact quantiles and the mean of one value per key; a key without values has NULLs."""
    means = rows.groupBy(key).agg(F.avg(value).alias("mean"))
    return means.join(exact_quantiles(rows, [key], value, ranks), key, "left")


# The measures with quantiles: their column and their name in the baseline.
_NAMES = {
    "duration_seconds": "duration",
    "app_vcore_seconds": "app_vcore_seconds",
    "app_memory_gb_seconds": "app_memory_gb_seconds",
    "p95_task_duration_ms": "task",
}


def local_baseline(samples: DataFrame) -> DataFrame:
    """In-batch baseline per family over all samples of the batch: exact quantiles
    at 0.5 and the true 0.95, averages, and the count of samples with any measure.

    The averages are one partial aggregate; the quantiles of all measures come from one
    ranking of the long form (family, measure, value), with no family held whole in a task.
    Pin the samples first; they are read more than once.
    """
    counted = samples.where((F.col("job_id") != "") & has_measure())
    averages = counted.groupBy("job_id").agg(
        F.lit("SPARK").alias("job_type"),
        F.max(F.struct(*ORDER, "cluster_name"))["cluster_name"].alias("cluster_name"),
        F.avg("duration_seconds").alias("avg_duration"),
        F.avg("app_vcore_seconds").alias("avg_app_vcore_seconds"),
        F.avg("app_memory_gb_seconds").alias("avg_app_memory_gb_seconds"),
        F.avg("max_over_median_ratio").alias("avg_max_over_median_ratio"),
        F.count("*").alias("run_count"),
    )
    long = counted.unpivot("job_id", list(_NAMES), "measure", "value")
    ranked = exact_quantiles(
        long, ["job_id", "measure"], "value", {"p50": 0.5, "p95": BATCH_UPPER_RANK}
    )
    wide = ranked.groupBy("job_id").agg(
        *(
            F.max(F.when(F.col("measure") == column, F.col(rank))).alias(f"{rank}_{name}")
            for column, name in _NAMES.items()
            for rank in ("p50", "p95")
        )
    )
    return averages.join(
        wide.drop("p50_task").withColumnRenamed("p95_task", "p95_task_duration_ms"),
        "job_id",
        "left",
    ).select(*BASELINE_SCHEMA.names)
