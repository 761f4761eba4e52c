"""Declared schemas: the run-state columns read and the 18 fact columns written."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the run-state table, in the order they are read.
RUN_STATE_COLUMNS = (
    "run_date",
    "application_start_time",
    "application_end_time",
    "status",
    "dataproc_jobid",
    "dataproc_cluster_uuid",
    "spark_taskid",
    "spark_jobid",
    "cluster_config_details",
    "log_location",
    "application_id",
    "spark_event_metrics",
)

# The fact table. Timestamps hold UTC; the JSON columns hold text.
FACT_SCHEMA = T.StructType(
    [
        T.StructField("ingest_date", T.DateType()),
        T.StructField("ingest_timestamp", T.TimestampNTZType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("cluster_name", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("job_state", T.StringType()),
        T.StructField("job_start_time", T.TimestampNTZType()),
        T.StructField("job_end_time", T.TimestampNTZType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("yarn_application_ids", T.ArrayType(T.StringType())),
        T.StructField("cluster_metrics", T.StringType()),
        T.StructField("job_metrics", T.StringType()),
        T.StructField("driver_log_excerpt", T.StringType()),
        T.StructField("yarn_log_excerpt", T.StringType()),
        T.StructField("spark_event_snippet", T.StringType()),
        T.StructField("anomaly_flags", T.StringType()),
    ]
)

STAGE_EVIDENCE = T.StructType(
    [
        T.StructField("stage_id", T.StringType()),
        T.StructField("stage_name", T.StringType()),
        T.StructField("max_task_duration_ms", T.DoubleType()),
        T.StructField("p95_task_duration_ms", T.DoubleType()),
        T.StructField("num_tasks", T.LongType()),
    ]
)

# One typed struct holds the evidence of every detector; a finding fills its own
# fields and the rest stay NULL, so they do not show in the JSON form.
EVIDENCE = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("baseline_p50_seconds", T.DoubleType()),
        T.StructField("baseline_p95_seconds", T.DoubleType()),
        T.StructField("baseline_run_count", T.LongType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("num_tasks", T.LongType()),
        T.StructField("p95_task_duration_ms", T.DoubleType()),
        T.StructField("max_task_duration_ms", T.DoubleType()),
        T.StructField("stage", STAGE_EVIDENCE),
        T.StructField("metric", T.StringType()),
        T.StructField("current", T.DoubleType()),
        T.StructField("baseline_average", T.DoubleType()),
        T.StructField("executor_peak", T.DoubleType()),
        T.StructField("total_workers", T.LongType()),
        T.StructField("autoscaling_enabled", T.BooleanType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("evidence", EVIDENCE),
        T.StructField("action", T.StringType()),
    ]
)

BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("cluster_name", T.StringType()),
        T.StructField("p50_duration", T.DoubleType()),
        T.StructField("p95_duration", T.DoubleType()),
        T.StructField("avg_duration", T.DoubleType()),
        T.StructField("p50_app_vcore_seconds", T.DoubleType()),
        T.StructField("p95_app_vcore_seconds", T.DoubleType()),
        T.StructField("avg_app_vcore_seconds", T.DoubleType()),
        T.StructField("p50_app_memory_gb_seconds", T.DoubleType()),
        T.StructField("p95_app_memory_gb_seconds", T.DoubleType()),
        T.StructField("avg_app_memory_gb_seconds", T.DoubleType()),
        T.StructField("avg_max_over_median_ratio", T.DoubleType()),
        T.StructField("p95_task_duration_ms", T.DoubleType()),
        T.StructField("run_count", T.LongType()),
    ]
)
BASELINE_FIELDS = tuple(f.name for f in BASELINE_SCHEMA.fields if f.name != "job_id")
