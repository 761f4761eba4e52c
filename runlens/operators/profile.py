"""One narrow row per run: identity, order, measures, skew hints, cluster profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import clock, identity
from runlens.functions import metrics as M
from runlens.functions import variant as V
from runlens.params import Thresholds


def profile_runs(runs: DataFrame, *, uid: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """Read each JSON column once and keep what the later steps need.

    ``uid`` names a unique run key; it breaks ties in the processing order.
    The parsed documents stay in the frame for the fact columns; ``narrow`` drops them.
    """
    ids = [F.col(c) for c in ("spark_jobid", "spark_taskid", "application_id")]
    start = clock.utc(runs, "application_start_time")
    end = clock.utc(runs, "application_end_time")
    whole = runs.select(
        "*",
        V.parse(F.col("spark_event_metrics")).alias("metrics_whole"),
        V.parse(F.col("cluster_config_details")).alias("cluster_whole"),
        start.alias("job_start_time"),
        end.alias("job_end_time"),
        F.col(uid).cast("string").alias("uid"),
    )
    metrics = F.col("spark_event_metrics"), F.col("metrics_whole")
    cluster = F.col("cluster_config_details"), F.col("cluster_whole")
    parsed = whole.select(
        *(c for c in whole.columns if c not in ("metrics_whole", "cluster_whole")),
        F.coalesce(metrics[1], V.sections(*metrics, M.METRIC_SECTIONS)).alias("metrics_doc"),
        F.coalesce(cluster[1], V.sections(*cluster, M.CLUSTER_SECTIONS)).alias("cluster_doc"),
        V.too_large(*metrics).alias("metrics_part"),
        V.too_large(*cluster).alias("cluster_part"),
    )
    v = F.col("metrics_doc")
    # Each step names what later steps use more than once, so that it is computed once.
    opened = parsed.select(
        "*",
        V.field(v, "$.app").alias("app_doc"),
        V.objects(v, "$.jobs").alias("job_docs"),
        M.stage_rows(v).alias("stages"),
        identity.job_family(*ids).alias("family"),
        identity.run_identifier(*ids).alias("run_identifier"),
    )
    picked = opened.select(
        "*",
        M.first_job(F.col("job_docs")).alias("first_job_doc"),
        M.worst_job(F.col("job_docs"), limits.straggler_warning).alias("worst_job_doc"),
    )
    app = F.col("app_doc")
    return picked.select(
        *(c for c in picked.columns if c not in ("job_docs", "stages", "family", "worst_job_doc")),
        F.coalesce(identity.non_empty(F.col("family")), F.col("run_identifier")).alias("job_id"),
        F.coalesce(
            identity.non_empty(identity.cluster_name(F.col("dataproc_jobid"))), F.lit("unknown")
        ).alias("cluster_name"),
        F.coalesce(identity.non_empty(F.col("status")), F.lit("UNKNOWN")).alias("job_state"),
        clock.duration_seconds(F.col("job_start_time"), F.col("job_end_time")).alias(
            "duration_seconds"
        ),
        *clock.order_columns(
            F.col("job_start_time"), F.col("job_end_time"), F.col("run_date")
        ),
        V.number(app, "$.app_vcore_seconds").alias("app_vcore_seconds"),
        V.number(app, "$.app_memory_gb_seconds").alias("app_memory_gb_seconds"),
        V.number(app, "$.executor_peak").alias("executor_peak"),
        M.job_sample(F.col("first_job_doc")).alias("sample"),
        M.job_details(F.col("worst_job_doc")).alias("skewed_job"),
        M.worst_stage(F.col("stages")).alias("skewed_stage"),
        M.cluster_profile(F.col("cluster_doc")).alias("cluster_profile"),
        M.cost_summary(v).alias("cost_summary"),
        (
            V.unreadable(F.col("spark_event_metrics"), v)
            | V.unreadable(F.col("cluster_config_details"), F.col("cluster_doc"))
        ).alias("unreadable"),
    )


def narrow(profiled: DataFrame) -> DataFrame:
    """The profile without documents and raw columns: all that baselines, detectors and
    report need. Small enough to pin, so that the documents are parsed once for them."""
    return profiled.select(
        *clock.ORDER,
        "job_id", "cluster_name", "job_state", "duration_seconds", "app_vcore_seconds",
        "app_memory_gb_seconds", "executor_peak", "sample", "skewed_job", "skewed_stage",
        "cluster_profile", "cost_summary", "unreadable",
    )


MEASURES = (
    "duration_seconds",
    "app_vcore_seconds",
    "app_memory_gb_seconds",
    "max_over_median_ratio",
    "p95_task_duration_ms",
)


def samples(profiled: DataFrame) -> DataFrame:
    """The rows a running baseline is made of: key, order and five measures."""
    return profiled.select(
        "job_id",
        *clock.ORDER,
        "cluster_name",
        "duration_seconds",
        "app_vcore_seconds",
        "app_memory_gb_seconds",
        F.col("sample.ratio").alias("max_over_median_ratio"),
        F.col("sample.p95_task_duration_ms").alias("p95_task_duration_ms"),
    )


def has_measure():
    """A run counts as a sample if any of its five measures is there."""
    return F.coalesce(*(F.col(m) for m in MEASURES)).isNotNull()
