"""One registered query per operator, each over whole derived tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.checks import duck as D
from runlens import fixed as X
from runlens.fixtures import AS_OF, PARAMS, duck_with, load
from runlens.functions import clock, identity
from runlens.functions import metrics as M
from runlens.functions import variant as V
from runlens.operators import report as R
from runlens.operators.baseline import (
    exact_quantile_summary,
    historical_baseline,
    local_baseline,
)
from runlens.operators.facts import fact_rows, memory_summary, outcomes
from runlens.operators.profile import profile_runs, samples
from runlens.operators.ranking import exact_quantiles, line_numbers
from runlens.operators.resolve import attach_history
from runlens.operators.running import running_baselines
from runlens.plans.monitor import Analysis, analyse, ingest, stored_outcomes
from runlens.sources import event_logs, history, logs, series, snapshots
from runlens.sources.run_state import ingest_summary, scan_runs
from runlens.storage import pin, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UID = "run_no"
EVENTS_FROM, EVENTS_TO = datetime(2024, 1, 2), datetime(2024, 1, 20)
START, END = PARAMS.window(AS_OF)
HISTORY_START, HISTORY_END = PARAMS.history_window(AS_OF)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def text(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("string").alias(alias or name)


def close(name: str, alias: str | None = None, digits: int = 4) -> Column:
    """Averages depend on the order of addition in their last bits."""
    return F.round(F.col(name), digits).alias(alias or name)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "run_state")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select(
        "*",
        V.parse(F.col("spark_event_metrics")).alias("v"),
        V.parse(F.col("cluster_config_details")).alias("c"),
    )


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    return profile_runs(_runs(spark, sf), uid=UID).withColumn("run_no", F.col(UID))


def _analysis(spark: SparkSession, sf: str) -> Analysis:
    ingested = ingest(_runs(spark, sf), PARAMS, AS_OF, uid=UID)
    return analyse(ingested.runs, load(spark, sf, "daily_facts"), PARAMS, AS_OF, uid=UID)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).found


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return fact_rows(_analysis(spark, sf).wide, PARAMS, AS_OF)


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return pin(outcomes(_found(spark, sf)))


def _findings(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    exploded = V.unnest(_found(spark, sf), F.col("findings"), "f", "uid")
    return exploded.select(F.col("uid").cast("bigint").alias("run_no"), "f.*").where(
        F.col("kind").isin(*kinds)
    )


RUNS = duck_with("run_state")
ALL = duck_with("run_state") + ",\n" + D.profile("run_state")
FULL = duck_with("run_state", "daily_facts") + ",\n" + D.FULL
REPORT = duck_with("run_state", "daily_facts") + ",\n" + D.REPORT


# --- scans and sinks ---------------------------------------------------------------------


@query(f"""{RUNS}, {D.WINDOW}
SELECT run_no, CAST(run_date AS VARCHAR) AS run_date, CAST(application_start_time AS VARCHAR) AS application_start_time,
  CAST(application_end_time AS VARCHAR) AS application_end_time, status, dataproc_jobid, dataproc_cluster_uuid, spark_taskid,
  spark_jobid, cluster_config_details, log_location, application_id, spark_event_metrics
FROM win""")
def run_scan(spark, sf):
    rows = scan_runs(_runs(spark, sf), START, END, ordered=True, keep=(UID,))
    times = ("run_date", "application_start_time", "application_end_time")
    return rows.select(*(text(c) if c in times else F.col(c) for c in rows.columns))


@query(f"""{duck_with("daily_facts")}, {D.HISTORY}
SELECT job_id, job_type, cluster_name, duration_seconds, vcores AS app_vcore_seconds, memory AS app_memory_gb_seconds,
  ratio AS max_over_median_ratio, p95 AS p95_task_duration_ms FROM raw_history""")
def history_scan(spark, sf):
    return history.scan_history(load(spark, sf, "daily_facts"), HISTORY_START, HISTORY_END)


@query(f"""{duck_with("daily_facts")}
SELECT CAST(ingest_timestamp AS VARCHAR) AS ingest_timestamp, job_id, job_state, cluster_name, duration_seconds, driver_log_excerpt
FROM daily_facts ORDER BY daily_facts.ingest_timestamp DESC, job_id, driver_log_excerpt LIMIT 50""")
def recent_facts(spark, sf):
    rows = history.recent_facts(
        load(spark, sf, "daily_facts"), tiebreak=("job_id", "driver_log_excerpt")
    )
    return rows.select(
        text("ingest_timestamp"), "job_id", "job_state", "cluster_name", "duration_seconds",
        "driver_log_excerpt",
    )


@query(f"""{RUNS}, doc AS (SELECT run_no, CASE WHEN json_valid(spark_event_metrics) THEN spark_event_metrics ELSE '{{}}' END AS m,
  CASE WHEN json_valid(cluster_config_details) THEN cluster_config_details ELSE '{{}}' END AS c FROM run_state)
SELECT run_no, json_type(m) = 'OBJECT' AS metrics_object, json_type(c) = 'OBJECT' AS cluster_object,
  json_extract_string(m, '$.app.app_id') AS app_id,
  try_cast(json_extract_string(c, '$.config.workerConfig.numInstances') AS BIGINT) AS workers FROM doc""")
def fact_decode(spark, sf):
    stored = _runs(spark, sf).select(
        "run_no",
        F.col("spark_event_metrics").alias("job_metrics"),
        F.col("cluster_config_details").alias("cluster_metrics"),
        F.lit(None).cast("string").alias("anomaly_flags"),
    )
    rows = history.decode_facts(stored)
    m, c = F.col("job_metrics"), F.col("cluster_metrics")
    return rows.select(
        "run_no",
        V.is_object(m).alias("metrics_object"),
        V.is_object(c).alias("cluster_object"),
        V.text(m, "$.app.app_id").alias("app_id"),
        V.integer(c, "$.config.workerConfig.numInstances").alias("workers"),
    )


@query(f"""{RUNS}, {D.WINDOW}
SELECT '2000-01-01 00:00:00' AS window_start, '2000-06-29 00:00:00' AS window_end, count(*) AS run_count,
  count(DISTINCT nullif(trim(dataproc_jobid), '')) AS distinct_clusters FROM win""")
def ingest_summary_(spark, sf):
    rows = scan_runs(_runs(spark, sf), START, END)
    return ingest_summary(rows, START, END).select(
        text("window_start"), text("window_end"), "run_count", "distinct_clusters"
    )


@query(f"""{duck_with("clusters")}
SELECT cluster_name, cluster_uuid AS uuid, nullif(cluster_uuid, '') AS cluster_uuid, coalesce(state, 'UNKNOWN') AS status,
  strftime(first_history_time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS create_time,
  strftime(state_start_time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS update_time,
  image_version, segment AS label_segment, CAST(capacity AS VARCHAR) AS hdfs_capacity, CAST(pending AS VARCHAR) AS yarn_pending
FROM clusters""")
def cluster_snapshot(spark, sf):
    flat = load(spark, sf, "clusters")
    nested = flat.select(
        "cluster_name",
        "cluster_uuid",
        F.create_map(F.lit("segment"), F.col("segment")).alias("labels"),
        F.struct(
            "state",
            "state_start_time",
            F.array(F.struct(F.col("first_history_time").alias("state_start_time"))).alias("history"),
        ).alias("status"),
        F.struct(
            F.create_map(F.lit("capacity"), text("capacity")).alias("hdfs_metrics"),
            F.create_map(F.lit("pending"), text("pending")).alias("yarn_metrics"),
        ).alias("metrics"),
        F.struct(
            F.struct(
                "image_version",
                F.array(F.lit("JUPYTER")).alias("optional_components"),
                F.create_map(F.lit("k"), F.lit("v")).alias("properties"),
            ).alias("software_config")
        ).alias("config"),
    )
    rows = snapshots.cluster_snapshots(nested, PARAMS.project_id, PARAMS.region)
    return rows.select(
        "cluster_name", "uuid", "cluster_uuid", "status", "create_time", "update_time",
        F.col("software_config.image_version").alias("image_version"),
        F.col("labels")["segment"].alias("label_segment"),
        F.col("metrics.hdfs_metrics")["capacity"].alias("hdfs_capacity"),
        F.col("metrics.yarn_metrics")["pending"].alias("yarn_pending"),
    )


def _nested_jobs(spark: SparkSession, sf: str) -> DataFrame:
    flat = load(spark, sf, "job_snapshots")
    blank = F.lit(None).cast("string")
    return flat.select(
        "job_no",
        F.struct(F.col("ref_job_id").alias("job_id"), F.lit("p").alias("project_id")).alias("reference"),
        "job_uuid",
        F.lit("SPARK").alias("type"),
        F.create_map(F.lit("no"), text("job_no")).alias("labels"),
        F.struct(F.lit("").alias("cluster_name"), F.lit("u").alias("cluster_uuid")).alias("placement"),
        F.struct(
            "state", blank.alias("substate"),
            F.lit(None).cast("timestamp_ntz").alias("start_time"),
            F.lit(None).cast("timestamp_ntz").alias("end_time"),
            "state_start_time",
        ).alias("status"),
        F.array(
            F.struct(
                "state", F.col("first_history_time").alias("state_start_time"), blank.alias("details")
            )
        ).alias("status_history"),
        F.array(
            F.struct(F.col("app_id").alias("application_id"), F.col("app_name").alias("name")),
            F.struct(F.lit("").alias("application_id"), F.lit("").alias("name")),
        ).alias("yarn_applications"),
        blank.alias("driver_output_resource_uri"),
        blank.alias("driver_control_files_uri"),
    )


@query(f"""{duck_with("job_snapshots")}
SELECT coalesce(ref_job_id, job_uuid) AS job_id, ref_job_id AS reference_job_id, state,
  strftime(state_start_time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS state_timestamp, coalesce(app_id, app_name) AS yarn_ids,
  CAST(NULL AS VARCHAR) AS cluster_name, 'u' AS cluster_uuid,
  state || '@' || coalesce(strftime(first_history_time, '%Y-%m-%dT%H:%M:%S') || '+00:00', '-') AS history
FROM job_snapshots""")
def job_snapshot(spark, sf):
    rows = snapshots.job_snapshots(_nested_jobs(spark, sf), "p", "r1")
    return rows.select(
        "job_id",
        F.col("reference.job_id").alias("reference_job_id"),
        "state",
        "state_timestamp",
        F.array_join("yarn_application_ids", ",").alias("yarn_ids"),
        "cluster_name",
        "cluster_uuid",
        F.array_join(
            F.transform(
                "status_history",
                lambda s: F.concat(
                    s["state"], F.lit("@"), F.coalesce(s["state_start_time"], F.lit("-"))
                ),
            ),
            ",",
        ).alias("history"),
    )


@query(f"""{duck_with("job_snapshots")}, t AS (SELECT job_no, coalesce(state_start_time, first_history_time) AS submitted FROM job_snapshots)
SELECT job_no, CAST(submitted AS VARCHAR) AS submitted FROM t
WHERE submitted IS NULL OR submitted BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-06-29'""")
def jobs_in_window(spark, sf):
    rows = snapshots.jobs_in_window(_nested_jobs(spark, sf), START, END)
    return rows.select("job_no", snapshots.submission_time(rows).cast("string").alias("submitted"))


_LOGS = duck_with("log_entries")
_LOG_WINDOW = "timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'"


@query(f"""{_LOGS}
SELECT event_id, cluster_name, severity FROM log_entries
WHERE resource_type = 'cloud_dataproc_cluster' AND logger = 'Driver' AND cluster_name = 'cluster-3' AND {_LOG_WINDOW}""")
def driver_logs(spark, sf):
    rows = logs.driver_logs(
        load(spark, sf, "log_entries"), EVENTS_FROM, EVENTS_TO, cluster_name="cluster-3"
    )
    return rows.select("event_id", "cluster_name", "severity")


@query(f"""{_LOGS}
SELECT event_id, yarn_application_id, severity FROM log_entries
WHERE resource_type = 'cloud_dataproc_worker' AND logger = 'ContainerExecutor' AND yarn_application_id = 'application_2' AND {_LOG_WINDOW}""")
def container_logs(spark, sf):
    rows = logs.container_logs(
        load(spark, sf, "log_entries"), EVENTS_FROM, EVENTS_TO, yarn_application_id="application_2"
    )
    return rows.select("event_id", "yarn_application_id", "severity")


@query(f"""{_LOGS}
SELECT * FROM (SELECT cluster_name, row_number() OVER (PARTITION BY cluster_name ORDER BY timestamp, event_id) AS line_no,
    event_id, severity, coalesce(nullif(text_payload, ''), message, '') AS text
  FROM log_entries WHERE resource_type = 'cloud_dataproc_cluster' AND logger = 'Driver' AND {_LOG_WINDOW}) t
WHERE line_no <= 20""")
def log_lines(spark, sf):
    entries = logs.driver_logs(load(spark, sf, "log_entries"), EVENTS_FROM, EVENTS_TO)
    rows = logs.log_lines(entries, entry_id="event_id", per="cluster_name", limit=20)
    return rows.select(
        "cluster_name", F.col("line_no").cast("bigint").alias("line_no"), "event_id", "severity", "text"
    )


_POINTS = duck_with("metric_values")
_POINT_WINDOW = "end_time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'"
_VALUE = "coalesce(double_value, CAST(int64_value AS DOUBLE), CAST(nullif(distribution_count, 0) AS DOUBLE), 0)"
_CLUSTER_TYPES, _JOB_TYPES = (", ".join(f"'{n}'" for n in t) for t in (X.CLUSTER_METRIC_TYPES, X.JOB_METRIC_TYPES))


@query(f"""{_POINTS}
SELECT event_id, metric_type, cluster_name FROM metric_values
WHERE metric_type IN ({_CLUSTER_TYPES}) AND resource_type = 'cloud_dataproc_cluster' AND region = 'r1'
  AND cluster_name = 'cluster-2' AND {_POINT_WINDOW}""")
def cluster_metrics(spark, sf):
    rows = series.cluster_metrics(
        load(spark, sf, "metric_values"), EVENTS_FROM, EVENTS_TO, region="r1", cluster_name="cluster-2"
    )
    return rows.select("event_id", "metric_type", "cluster_name")


@query(f"""{_POINTS}
SELECT event_id, metric_type, job_id FROM metric_values
WHERE metric_type IN ({_JOB_TYPES})
  AND resource_type = 'cloud_dataproc_job' AND job_id = 'job-5' AND {_POINT_WINDOW}""")
def job_metrics_series(spark, sf):
    rows = series.job_metrics(
        load(spark, sf, "metric_values"), EVENTS_FROM, EVENTS_TO, job_id="job-5"
    )
    return rows.select("event_id", "metric_type", "job_id")


@query(f"""{_POINTS}
SELECT event_id, metric_type, CAST(end_time AS VARCHAR) AS timestamp, {_VALUE} AS value FROM metric_values""")
def metric_points(spark, sf):
    rows = series.metric_points(load(spark, sf, "metric_values"), "event_id", "metric_type")
    return rows.select("event_id", "metric_type", text("timestamp"), "value")


@query(f"""{_POINTS}
SELECT metric_type, cluster_name, region, CAST(end_time AS VARCHAR) AS timestamp, {_VALUE} AS value,
  row_number() OVER (PARTITION BY metric_type, cluster_name, region ORDER BY end_time, {_VALUE}) AS place FROM metric_values""")
def metric_series(spark, sf):
    rows = series.metric_series(load(spark, sf, "metric_values"), "metric_type", "cluster_name", "region")
    return rows.select("metric_type", "cluster_name", "region", text("timestamp"), "value", "place")


@query("""SELECT event_type, CAST(ts AS VARCHAR) AS timestamp, coalesce(value, 0) AS value,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, coalesce(value, 0)) AS place FROM events""")
def metric_series_long(spark, sf):
    """A series for each event type: at the scale of the checks well over 10,000 points in one table."""
    points = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_type",
        F.col("ts").alias("end_time"),
        F.col("value").alias("double_value"),
        F.lit(None).cast("bigint").alias("int64_value"),
        F.lit(None).cast("bigint").alias("distribution_count"),
    )
    rows = series.metric_series(points, "event_type")
    return rows.select("event_type", text("timestamp"), "value", "place")


@query(f"""{duck_with("run_state", "event_log_files")},
app_ids AS (SELECT application_id FROM run_state WHERE application_id IS NOT NULL
  UNION SELECT 'job_' || CAST(run_no % 10 AS VARCHAR) FROM run_state)
SELECT application_id, name AS blob_name, CAST(strlen(text) AS BIGINT) AS size_bytes, strlen(text) > 2000 AS truncated,
  md5(CASE WHEN strlen(text) > 2000 THEN 'cut' ELSE text END) AS content_md5, least(strlen(text), 2000) BETWEEN 1997 AND 2006 AS near_cap
FROM event_log_files JOIN app_ids ON starts_with(name, 'logs/' || application_id)
WHERE name LIKE '%application!_%' ESCAPE '!' OR name LIKE '%job!_%' ESCAPE '!'""")
def event_log_scan(spark, sf):
    content = F.encode(F.col("text"), "UTF-8")
    files = load(spark, sf, "event_log_files").select(
        "name", F.octet_length(content).cast("bigint").alias("length"), content.alias("content")
    )
    runs = _runs(spark, sf)
    ids = runs.where(F.col("application_id").isNotNull()).select("application_id").union(
        runs.select(F.concat(F.lit("job_"), (F.col("run_no") % 10).cast("string")))
    )
    rows = event_logs.select_event_logs(
        files, ids, prefix="logs/", max_bytes=2000
    )
    return rows.select(
        "application_id", "blob_name", "size_bytes", "truncated",
        F.md5(F.when(F.col("truncated"), F.lit("cut")).otherwise(F.col("content_snippet"))).alias("content_md5"),
        F.octet_length("content_snippet").cast("bigint").between(1997, 2006).alias("near_cap"),
    )


# --- field functions ---------------------------------------------------------------------


@query(f"""{RUNS}, t AS (SELECT run_no, CASE WHEN json_valid(spark_event_metrics) THEN spark_event_metrics END AS m FROM run_state)
SELECT run_no, CASE WHEN m IS NULL OR json_type(m) = 'NULL' THEN 'empty' WHEN json_type(m) = 'OBJECT' THEN 'object' ELSE 'wrapped' END AS shape,
  CASE WHEN json_type(m) = 'ARRAY' THEN json_extract_string(m, '$[0]') END AS wrapped_first,
  json_extract_string(m, '$.app.app_id') AS app_id FROM t""")
def json_coerce(spark, sf):
    rows = _parsed(spark, sf).select(
        "run_no", V.as_object(F.col("v")).alias("o")
    )
    o = F.col("o")
    return rows.select(
        "run_no",
        F.when(V.text(o, "$") == "{}", F.lit("empty"))
        .when(V.field(o, "$.value").isNotNull(), F.lit("wrapped"))
        .otherwise(F.lit("object"))
        .alias("shape"),
        V.text(o, "$.value[0]").alias("wrapped_first"),
        V.text(o, "$.app.app_id").alias("app_id"),
    )


@query("""SELECT event_id, CAST(ts AS VARCHAR) AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events""")
def iso_utc(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select(
        "event_id", text("ts"), clock.iso_utc(clock.utc(rows, "ts")).alias("iso")
    )


@query(f"""{RUNS}
SELECT run_no, regexp_replace(coalesce(spark_jobid, ''), '_[0-9a-f]{{6,}}$', '', 'i') AS job,
  regexp_replace(coalesce(spark_taskid, ''), '_[0-9a-f]{{6,}}$', '', 'i') AS task,
  regexp_replace(coalesce(application_id, ''), '_[0-9a-f]{{6,}}$', '', 'i') AS app FROM run_state""")
def normalize_id(spark, sf):
    columns = {"job": "spark_jobid", "task": "spark_taskid", "app": "application_id"}
    return _runs(spark, sf).select(
        "run_no",
        *(identity.normalize_identifier(F.col(c)).alias(a) for a, c in columns.items()),
    )


_IDS = ("spark_jobid", "spark_taskid", "application_id")


@query(f"{ALL} SELECT run_no, family AS job_family, job_id AS primary_job_id FROM prof")
def job_family(spark, sf):
    ids = [F.col(c) for c in _IDS]
    return _runs(spark, sf).select(
        "run_no",
        identity.job_family(*ids).alias("job_family"),
        identity.primary_job_id(*ids).alias("primary_job_id"),
    )


@query(f"{ALL} SELECT run_no, run_identifier FROM prof")
def run_identifier(spark, sf):
    ids = [F.col(c) for c in _IDS]
    return _runs(spark, sf).select("run_no", identity.run_identifier(*ids).alias("run_identifier"))


@query(f"{ALL} SELECT run_no, dur AS duration_seconds, coalesce(trim(dataproc_jobid), '') AS cluster_name FROM prof")
def run_duration(spark, sf):
    rows = _runs(spark, sf)
    return rows.select(
        "run_no",
        clock.duration_seconds(
            clock.utc(rows, "application_start_time"), clock.utc(rows, "application_end_time")
        ).alias("duration_seconds"),
        identity.cluster_name(F.col("dataproc_jobid")).alias("cluster_name"),
    )


@query(f"""{ALL}, {D.JOBS}
SELECT run_no, CAST(i AS BIGINT) AS pos, json_extract_string(j, '$.job_id') AS job_id, json_extract_string(j, '$.job_name') AS job_name,
  try_cast(json_extract_string(j, '$.max_over_median_ratio') AS DOUBLE) AS ratio FROM jobs""")
def job_metric_rows(spark, sf):
    rows = V.unnest(_parsed(spark, sf), M.job_rows(F.col("v")), "j", "run_no", pos="pos")
    j = F.col("j")
    return rows.select(
        "run_no",
        F.col("pos").cast("bigint").alias("pos"),
        V.text(j, "$.job_id").alias("job_id"),
        V.text(j, "$.job_name").alias("job_name"),
        V.number(j, "$.max_over_median_ratio").alias("ratio"),
    )


@query(f"""{ALL} SELECT run_no, json_extract_string(mj, '$.app.app_vcore_seconds') AS app_vcore_seconds,
  json_extract_string(mj, '$.app.app_memory_gb_seconds') AS app_memory_gb_seconds,
  json_extract_string(mj, '$.app.executor_peak') AS executor_peak FROM prof""")
def cost_summary(spark, sf):
    rows = _parsed(spark, sf).select("run_no", M.cost_summary(F.col("v")).alias("c"))
    names = ("app_vcore_seconds", "app_memory_gb_seconds", "executor_peak")
    return rows.select("run_no", *(V.text(F.col(f"c.{n}"), "$").alias(n) for n in names))


@query(f"""{ALL} SELECT run_no, try_cast(json_extract_string(cj, '$.config.workerConfig.numInstances') AS BIGINT) AS primary_workers,
  try_cast(json_extract_string(cj, '$.config.secondaryWorkerConfig.numInstances') AS BIGINT) AS secondary_workers, workers AS total_workers,
  json_extract_string(cj, '$.config.workerConfig.machineTypeUri') AS primary_machine_type,
  json_extract_string(cj, '$.config.secondaryWorkerConfig.machineTypeUri') AS secondary_machine_type,
  coalesce(json_type(cj, '$.config.autoscalingConfig') = 'OBJECT', FALSE) AS autoscaling_enabled FROM prof""")
def cluster_profile(spark, sf):
    rows = _parsed(spark, sf).select("run_no", M.cluster_profile(F.col("c")).alias("p"))
    return rows.select("run_no", "p.*")


@query(f"""{ALL}, {D.JOBS}
SELECT run_no, CAST(i AS BIGINT) AS pos, try_cast(json_extract_string(j, '$.max_over_median_ratio') AS DOUBLE) AS as_float,
  CASE WHEN json_type(j, '$.num_tasks') <> 'NULL' THEN try_cast(json_extract_string(j, '$.num_tasks') AS BIGINT) END AS as_int,
  try_cast(json_extract_string(j, '$.job_name') AS DOUBLE) AS name_as_float FROM jobs""")
def safe_cast(spark, sf):
    rows = V.unnest(
        _parsed(spark, sf), V.objects(F.col("v"), "$.jobs"), "j", "run_no", pos="pos"
    )
    j = F.col("j")
    return rows.select(
        "run_no",
        F.col("pos").cast("bigint").alias("pos"),
        V.number(j, "$.max_over_median_ratio").alias("as_float"),
        V.integer(j, "$.num_tasks").alias("as_int"),
        V.number(j, "$.job_name").alias("name_as_float"),
    )


@query(f"""{ALL}, first_job AS (SELECT run_no, json_extract(mj, '$.jobs[0]') AS j, json_extract(mj, '$.app') AS app FROM prof),
lines AS (SELECT run_no,
  CASE WHEN app IS NOT NULL THEN 'Application unknown (' || (app->>'$.app_id') || ') duration=n/ams executors=' || (app->>'$.executor_peak') || chr(10)
    || '  Resource usage: vcore_seconds=' || format('{{:.2f}}', CAST(app->>'$.app_vcore_seconds' AS DOUBLE)) || ' memory_gb_seconds=' || (app->>'$.app_memory_gb_seconds') END AS a,
  CASE WHEN j IS NOT NULL THEN '  Job ' || (j->>'$.job_id') || ' tasks=' || (j->>'$.num_tasks') || ' duration=n/ams p95=' || (j->>'$.p95_task_duration_ms') || 'ms' || chr(10)
    || '    Straggler ratio: ' || CASE WHEN json_type(j, '$.max_over_median_ratio') = 'VARCHAR' THEN j->>'$.max_over_median_ratio'
      ELSE format('{{:.2f}}', CAST(j->>'$.max_over_median_ratio' AS DOUBLE)) END END AS b FROM first_job)
SELECT run_no, nullif(concat_ws(chr(10), a, b), '') AS snippet FROM lines""")
def event_snippet(spark, sf):
    rows = _parsed(spark, sf).select(
        "run_no",
        V.field(F.col("v"), "$.app").alias("app"),
        M.first_job(V.objects(F.col("v"), "$.jobs")).alias("job"),
    )
    return rows.select("run_no", M.event_snippet(F.col("app"), F.col("job")).alias("snippet"))


@query(f"{ALL} SELECT run_no, ratio0 AS max_over_median_ratio, p95_0 AS p95_task_duration_ms FROM prof")
def job_sample(spark, sf):
    first = M.first_job(V.objects(F.col("v"), "$.jobs")).alias("job")
    rows = _parsed(spark, sf).select("run_no", first)
    rows = rows.select("run_no", M.job_sample(F.col("job")).alias("s"))
    return rows.select(
        "run_no",
        F.col("s.ratio").alias("max_over_median_ratio"),
        F.col("s.p95_task_duration_ms").alias("p95_task_duration_ms"),
    )


@query(f"""{ALL}, {D.STAGES}
SELECT run_no, stage_id, name, num_tasks, max_ms AS max_task_duration_ms, p95_ms AS p95_task_duration_ms FROM stages""")
def stage_rows(spark, sf):
    rows = V.unnest(_parsed(spark, sf), M.stage_rows(F.col("v")), "s", "run_no")
    return rows.select("run_no", "s.*")


@query(f"""{RUNS}
SELECT run_no, CASE WHEN regexp_replace(spark_jobid, '_[0-9a-f]{{6,}}$', '') <> '' THEN regexp_replace(spark_jobid, '_[0-9a-f]{{6,}}$', '')
  ELSE spark_jobid END AS logical_job_id FROM run_state""")
def logical_id(spark, sf):
    return _runs(spark, sf).select(
        "run_no", identity.logical_id(F.col("spark_jobid")).alias("logical_job_id")
    )


# --- baselines ---------------------------------------------------------------------------

_STATS = (
    ("p50_duration", "p50_duration"), ("p95_duration", "p95_duration"), ("avg_duration", "avg_duration"),
    ("p50_app_vcore_seconds", "p50_vcore"), ("p95_app_vcore_seconds", "p95_vcore"), ("avg_app_vcore_seconds", "avg_vcore"),
    ("p50_app_memory_gb_seconds", "p50_memory"), ("p95_app_memory_gb_seconds", "p95_memory"), ("avg_app_memory_gb_seconds", "avg_memory"),
    ("avg_max_over_median_ratio", "avg_ratio"), ("p95_task_duration_ms", "p95_task"),
)


def _digits(name: str) -> int:
    # Mean ratios often end in a tie at few digits; the other measures are whole numbers.
    return 9 if name == "avg_max_over_median_ratio" else 4


def _duck_stats(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{d}, {_digits(n)}) AS {n}" for n, d in _STATS) + f", {prefix}run_count AS run_count"


def _stats(prefix: str = "") -> list[Column]:
    return [*(close(prefix + n, n, _digits(n)) for n, _ in _STATS), F.col(f"{prefix}run_count").alias("run_count")]


def _baselines(spark: SparkSession, sf: str) -> DataFrame:
    scanned = history.scan_history(load(spark, sf, "daily_facts"), HISTORY_START, HISTORY_END)
    return historical_baseline(scanned)


@query(f"{duck_with('daily_facts')}, {D.HISTORY} SELECT job_id, job_type, cluster_name, {_duck_stats()} FROM hist")
def historical_baseline_(spark, sf):
    return _baselines(spark, sf).select("job_id", "job_type", "cluster_name", *_stats())


@query(f"""{duck_with('run_state', 'daily_facts')}, {D.profile('run_state')}, {D.HISTORY}
SELECT run_no, p.job_id, h.job_id IS NOT NULL AS has_history, h.p50_duration, round(h.avg_vcore, 4) AS avg_app_vcore_seconds, h.run_count
FROM prof p LEFT JOIN hist h ON h.job_id = p.job_id""")
def baseline_join(spark, sf):
    joined = attach_history(
        _profiled(spark, sf), pin(_baselines(spark, sf)), broadcast_rows=PARAMS.broadcast_rows
    )
    return joined.select(
        "run_no", "job_id", F.col("historical").isNotNull().alias("has_history"),
        F.col("historical.p50_duration").alias("p50_duration"),
        close("historical.avg_app_vcore_seconds", "avg_app_vcore_seconds"),
        F.col("historical.run_count").alias("run_count"),
    )


@query(f"""{FULL} SELECT run_no, job_id, source, b_cluster AS baseline_cluster, {_duck_stats('b_')} FROM resolved""")
def resolved_baseline(spark, sf):
    return _resolved(_found(spark, sf))


def _resolved(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("uid").cast("bigint").alias("run_no"), "job_id",
        F.col("baseline_source").alias("source"),
        F.col("baseline.cluster_name").alias("baseline_cluster"),
        *_stats("baseline."),
    )


@query("""SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
  round(avg(o_totalprice), 2) AS mean FROM (SELECT o_custkey % 150 AS o_custkey, o_totalprice FROM orders) t GROUP BY o_custkey""")
def exact_quantile(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_custkey") % 150).alias("o_custkey"), "o_totalprice"
    )
    summary = exact_quantile_summary(rows, "o_custkey", "o_totalprice", {"p50": 0.5, "p95": 0.95})
    return summary.select("o_custkey", close("p50"), close("p95"), close("mean", digits=2))


@query(f"""{ALL}, newest AS (SELECT job_id, cluster_name, row_number() OVER (PARTITION BY job_id
    ORDER BY k1 DESC, k2 DESC, run_identifier DESC, uid DESC) AS rn FROM sampled WHERE has),
grouped AS (SELECT job_id, quantile_cont(dur, 0.5) AS p50_duration, quantile_cont(dur, 0.95) AS p95_duration, avg(dur) AS avg_duration,
  quantile_cont(vcores, 0.5) AS p50_vcore, quantile_cont(vcores, 0.95) AS p95_vcore, avg(vcores) AS avg_vcore,
  quantile_cont(memory, 0.5) AS p50_memory, quantile_cont(memory, 0.95) AS p95_memory, avg(memory) AS avg_memory,
  avg(ratio0) AS avg_ratio, quantile_cont(p95_0, 0.95) AS p95_task, count(*) AS run_count
  FROM sampled WHERE has AND job_id <> '' GROUP BY job_id)
SELECT g.job_id, n.cluster_name, {_duck_stats('g.')} FROM grouped g JOIN newest n ON n.job_id = g.job_id AND n.rn = 1""")
def local_baseline_(spark, sf):
    rows = local_baseline(pin(samples(_profiled(spark, sf))))
    return rows.select("job_id", "cluster_name", *_stats())


@query(f"""{ALL}, {D.RUNNING} SELECT run_no, job_id, cluster_name, {_duck_stats()} FROM running WHERE run_count > 0""")
def running_baseline(spark, sf):
    rows = running_baselines(pin(samples(_profiled(spark, sf))), block_rows=PARAMS.block_rows)
    return rows.select(F.col("uid").cast("bigint").alias("run_no"), "job_id", "cluster_name", *_stats())


@query(ORACLES["running_baseline"])
def running_baseline_blocks(spark, sf):
    """Families cut into many blocks, as large ones are."""
    rows = running_baselines(pin(samples(_profiled(spark, sf))), block_rows=16)
    return rows.select(F.col("uid").cast("bigint").alias("run_no"), "job_id", "cluster_name", *_stats())


_TIGHT = replace(PARAMS, broadcast_rows=1, block_rows=16)


@query(ORACLES["resolved_baseline"])
def resolved_baseline_shuffled(spark, sf):
    """Both lookups too large to be broadcast."""
    ingested = ingest(_runs(spark, sf), _TIGHT, AS_OF, uid=UID)
    found = analyse(ingested.runs, load(spark, sf, "daily_facts"), _TIGHT, AS_OF, uid=UID).found
    return _resolved(found)


@query(f"""{duck_with('run_state', 'daily_facts')}, {D.profile('run_state')}, {D.HISTORY}
SELECT run_no, h.job_id IS NOT NULL AS has_history, h.p50_duration
FROM (SELECT run_no, CASE WHEN run_no % 3 = 0 THEN (SELECT min(job_id) FROM hist) ELSE job_id END AS job_id FROM prof) p
LEFT JOIN hist h ON h.job_id = p.job_id""")
def baseline_join_hot(spark, sf):
    """A third of all runs in one family, against a lookup that is shuffled."""
    baselines = pin(_baselines(spark, sf))
    hot = baselines.agg(F.min("job_id")).first()[0]
    runs = _profiled(spark, sf).select(
        "run_no", F.when(F.col("run_no") % 3 == 0, F.lit(hot)).otherwise(F.col("job_id")).alias("job_id")
    )
    joined = attach_history(runs, baselines, broadcast_rows=1)
    return joined.select(
        "run_no", F.col("historical").isNotNull().alias("has_history"),
        F.col("historical.p50_duration").alias("p50_duration"),
    )


@query("""SELECT grp, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95
FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 150 END AS grp, round(o_totalprice / 1000) AS o_totalprice FROM orders) t
GROUP BY grp""")
def exact_quantile_hot(spark, sf):
    """A third of all rows in one group, with many repeated values."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey") % 150).alias("grp"),
        F.round(F.col("o_totalprice") / 1000).alias("o_totalprice"),
    )
    found = exact_quantiles(rows, ["grp"], "o_totalprice", {"p50": 0.5, "p95": 0.95})
    return found.select(F.col("grp").cast("bigint").alias("grp"), close("p50"), close("p95"))


# --- detectors ---------------------------------------------------------------------------


@query(f"""{FULL} SELECT f.run_no, f.severity, f.message, f.action, r.job_id, r.dur AS duration_seconds, round(r.b_p50_duration, 4) AS baseline_p50_seconds,
  round(r.b_p95_duration, 4) AS baseline_p95_seconds, r.b_run_count AS baseline_run_count
FROM findings f JOIN resolved r ON r.run_no = f.run_no WHERE f.pos = 0""")
def runtime_regression(spark, sf):
    rows = _findings(spark, sf, "job_runtime_regression")
    return rows.select(
        "run_no", "severity", "message", "action", "evidence.job_id", "evidence.duration_seconds",
        close("evidence.baseline_p50_seconds", "baseline_p50_seconds"),
        close("evidence.baseline_p95_seconds", "baseline_p95_seconds"),
        "evidence.baseline_run_count",
    )


@query(f"""{FULL} SELECT f.run_no, f.severity, f.message, f.action, s.spark_job AS job_id, s.ratio, s.stage_id, s.stage_name,
  s.max_ms AS stage_max_ms, s.p95_ms AS stage_p95_ms FROM findings f JOIN strag s ON s.run_no = f.run_no WHERE f.pos = 1""")
def task_straggler(spark, sf):
    rows = _findings(spark, sf, "task_straggler_detected")
    return rows.select(
        "run_no", "severity", "message", "action", "evidence.job_id", "evidence.ratio",
        "evidence.stage.stage_id", "evidence.stage.stage_name",
        F.col("evidence.stage.max_task_duration_ms").alias("stage_max_ms"),
        F.col("evidence.stage.p95_task_duration_ms").alias("stage_p95_ms"),
    )


@query(f"""{ALL}, {D.JOBS}, {D.STAGES}, {D.WORST}
SELECT run_no, stage_id, name, num_tasks, max_ms AS max_task_duration_ms, p95_ms AS p95_task_duration_ms FROM worst_stage""")
def worst_stage(spark, sf):
    rows = _parsed(spark, sf).select("run_no", M.stage_rows(F.col("v")).alias("stages"))
    worst = F.array(M.worst_stage(F.col("stages")))
    return V.unnest(rows, worst, "s", "run_no").select("run_no", "s.*")


@query(f"""{FULL} SELECT f.run_no, f.severity, f.message, f.action, c.metric, c.cur AS current, round(c.base, 4) AS baseline_average,
  round(c.ratio, 4) AS ratio FROM findings f JOIN cost c ON c.run_no = f.run_no WHERE f.pos = 2""")
def cost_regression(spark, sf):
    rows = _findings(spark, sf, "cost_regression")
    return rows.select(
        "run_no", "severity", "message", "action", "evidence.metric", "evidence.current",
        close("evidence.baseline_average", "baseline_average"), close("evidence.ratio", "ratio"),
    )


@query(f"""{FULL} SELECT f.run_no, f.kind, f.severity, f.message, f.action, u.peak AS executor_peak, u.workers AS total_workers
FROM findings f JOIN used u ON u.run_no = f.run_no WHERE f.pos = 3""")
def cluster_rightsizing(spark, sf):
    rows = _findings(spark, sf, "cluster_underutilized", "cluster_capacity_near_limit")
    return rows.select(
        "run_no", "kind", "severity", "message", "action", "evidence.executor_peak", "evidence.total_workers"
    )


@query(f"""{FULL} SELECT run_no, job_id, run_identifier, kinds, n_findings, has_issues, vcores AS cost_vcores,
  b_p50_duration AS baseline_median, b_run_count AS baseline_runs FROM flagged""")
def anomaly_flags(spark, sf):
    """The nested payload, through its JSON form."""
    facts = _facts(spark, sf)
    flags = facts.select(
        F.regexp_extract("driver_log_excerpt", r"(\d+)$", 1).cast("bigint").alias("run_no"),
        V.parse(F.col("anomaly_flags")).alias("a"),
    )
    a = F.col("a")
    found = V.objects(a, "$.findings")
    return flags.select(
        "run_no",
        V.text(a, "$.job_family").alias("job_id"),
        V.text(a, "$.run_identifier").alias("run_identifier"),
        F.array_join(
            F.transform(
                found, lambda f: F.concat(V.text(f, "$.kind"), F.lit(":"), V.text(f, "$.severity"))
            ),
            ",",
        ).alias("kinds"),
        F.size(found).cast("bigint").alias("n_findings"),
        V.field(a, "$.has_issues", "boolean").alias("has_issues"),
        V.number(a, "$.cost_summary.app_vcore_seconds").alias("cost_vcores"),
        V.number(a, "$.baseline_reference.p50_duration").alias("baseline_median"),
        V.integer(a, "$.baseline_reference.run_count").alias("baseline_runs"),
    )


# --- facts -------------------------------------------------------------------------------


_FACT_ROWS = f"""{FULL} SELECT run_no, '2000-06-29' AS ingest_date, '2000-06-29 00:00:00' AS ingest_timestamp, 'demo-project' AS project_id, 'r1' AS region,
  cluster_name, job_id, 'SPARK' AS job_type, job_state, CAST(application_start_time AS VARCHAR) AS job_start_time,
  CAST(application_end_time AS VARCHAR) AS job_end_time, dur AS duration_seconds, coalesce(nullif(application_id, ''), '') AS app_ids,
  dataproc_cluster_uuid AS cluster_uuid, workers AS total_workers, json_extract_string(cj, '$.config.autoscalingConfig.policyUri') AS policy,
  log_location AS driver_log_excerpt, CAST(NULL AS VARCHAR) AS yarn_log_excerpt,
  run_identifier AS metadata_run, job_id AS metadata_family, json_extract_string(mj, '$.app.app_id') AS app_id, has_issues FROM flagged"""


def _flat_facts(facts: DataFrame) -> DataFrame:
    rows = history.decode_facts(facts)
    c, m, a = F.col("cluster_metrics"), F.col("job_metrics"), F.col("anomaly_flags")
    plain = ("project_id", "region", "cluster_name", "job_id", "job_type", "job_state", "duration_seconds",
             "driver_log_excerpt", "yarn_log_excerpt")
    return rows.select(
        F.regexp_extract("driver_log_excerpt", r"(\d+)$", 1).cast("bigint").alias("run_no"),
        *(text(t) for t in ("ingest_date", "ingest_timestamp", "job_start_time", "job_end_time")),
        *plain,
        F.array_join("yarn_application_ids", ",").alias("app_ids"),
        V.text(c, "$.dataproc_cluster_uuid").alias("cluster_uuid"),
        V.integer(c, "$.cluster_profile.total_workers").alias("total_workers"),
        V.text(c, "$.cluster_config_details.config.autoscalingConfig.policyUri").alias("policy"),
        V.text(m, "$.metadata.run_identifier").alias("metadata_run"),
        V.text(m, "$.metadata.job_family").alias("metadata_family"),
        V.text(m, "$.app.app_id").alias("app_id"),
        V.field(a, "$.has_issues", "boolean").alias("has_issues"),
    )


@query(_FACT_ROWS)
def fact_rows_(spark, sf):
    return _flat_facts(_facts(spark, sf))


@query(_FACT_ROWS)
def fact_roundtrip(spark, sf):
    """Facts of the window, appended to a new fact table and read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/facts-{datetime.now().timestamp():.6f}"
    history.append_facts(_facts(spark, sf), folder, as_path=True)
    return _flat_facts(history.read_facts(spark, folder))


@query(f"""{FULL} SELECT count(*) AS persisted_rows, TRUE AS dry_run, bool_or(has_issues) AS has_anomalies,
  count_if(NOT json_valid(coalesce(spark_event_metrics, '0')) OR NOT json_valid(coalesce(cluster_config_details, '0'))) AS unreadable_runs FROM flagged""")
def memory_summary_(spark, sf):
    return memory_summary(_outcomes(spark, sf), PARAMS.dry_run)


# --- report ------------------------------------------------------------------------------


@query(f"""{REPORT} SELECT job_state, n AS run_count, row_number() OVER (ORDER BY p) AS place
FROM (SELECT job_state, count(*) AS n, min(fact_pos) AS p FROM placed GROUP BY job_state) t""")
def state_counts(spark, sf):
    rows = R.state_counts(_outcomes(spark, sf))
    # States are a handful of names, one row each.
    place = F.row_number().over(Window.orderBy("first_seen")).cast("bigint")
    return rows.select("job_state", "run_count", place.alias("place"))


@query(f"""{REPORT} SELECT job_id, run_no, rank, kind, severity, message, action, cluster_name FROM worst""")
def worst_finding(spark, sf):
    rows = R.worst_findings(_outcomes(spark, sf))
    return rows.select(
        "job_id", F.col("uid").cast("bigint").alias("run_no"), F.col("rank").cast("bigint").alias("rank"),
        "kind", "severity", "message", "action", "cluster_name",
    )


@query(f"""{REPORT} SELECT job_id, run_identifier, cluster_name, message, b_p50_duration AS baseline_median, b_run_count AS baseline_runs,
  row_number() OVER (ORDER BY rank, first_pos) AS place FROM worst""")
def ranked_regressions(spark, sf):
    rows = R.worst_findings(_outcomes(spark, sf))
    numbered = line_numbers(rows, ["rank", "first_seen"])
    return numbered.select(
        "job_id", "run_identifier", "cluster_name", "message", "baseline_median", "baseline_runs",
        F.col("line_no").alias("place"),
    )


@query(f"""{REPORT}, listed AS (SELECT job_id, action, 0 AS l, rank AS a, first_pos AS b, 0 AS c FROM worst
  UNION ALL SELECT job_id, action, 1, 0, fact_pos, pos FROM issue_rows),
firsts AS (SELECT *, row_number() OVER (PARTITION BY job_id, action ORDER BY l, a, b, c) AS rn FROM listed)
SELECT job_id, action, row_number() OVER (ORDER BY l, a, b, c) AS place FROM firsts WHERE rn = 1""")
def suggested_actions(spark, sf):
    numbered = line_numbers(R.suggested_actions(_outcomes(spark, sf)), ["place", "job_id", "action"])
    return numbered.select("job_id", "action", F.col("line_no").alias("place"))


_SHOWN = "CASE WHEN json_type(mj, '$.app.{0}') = 'VARCHAR' THEN mj->>'$.app.{0}' ELSE format('{{:.1f}}', CAST(mj->>'$.app.{0}' AS DOUBLE)) END"
_HIGHLIGHTS = f"""highlighted AS (SELECT fact_pos, run_identifier, job_state, CASE WHEN coalesce(dur, 0) = 0 THEN 'n/a' ELSE format('{{:.1f}}s', dur) END AS duration,
  {_SHOWN.format('app_vcore_seconds')} AS vcore_text, {_SHOWN.format('app_memory_gb_seconds')} AS memory_text FROM placed ORDER BY fact_pos LIMIT 5)"""


@query(f"{REPORT}, {_HIGHLIGHTS} SELECT run_identifier, job_state, duration, vcore_text, memory_text FROM highlighted")
def highlights(spark, sf):
    rows = R.highlights(_outcomes(spark, sf))
    shown = F.when(
        F.col("duration_seconds") != 0,
        F.concat(F.call_function("format_number", "duration_seconds", F.lit("0.0")), F.lit("s")),
    ).otherwise(F.lit("n/a"))
    return rows.select(
        "run_identifier", "job_state", shown.alias("duration"), "vcore_text", "memory_text"
    )


@query(f"""{REPORT}, {_HIGHLIGHTS}, listed AS (SELECT job_id, action, 0 AS l, rank AS a, first_pos AS b, 0 AS c FROM worst
  UNION ALL SELECT job_id, action, 1, 0, fact_pos, pos FROM issue_rows),
firsts AS (SELECT *, row_number() OVER (PARTITION BY job_id, action ORDER BY l, a, b, c) AS rn FROM listed),
states AS (SELECT job_state, count(*) AS n, min(fact_pos) AS p FROM placed GROUP BY job_state),
lines AS (
 SELECT 0 AS s, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 'Dataproc monitoring summary' AS line
 UNION ALL SELECT 0, 1, 0, 0, 0, '=========================='
 UNION ALL SELECT 0, 2, 0, 0, 0, 'Jobs ingested: ' || CAST(sum(n) AS BIGINT) || ' (states: ' || string_agg(job_state || '=' || n, ', ' ORDER BY p) || ')' FROM states
 UNION ALL SELECT 1, 0, 0, 0, 0, ''
 UNION ALL SELECT 1, 1, 0, 0, 0, CASE WHEN count(*) > 0 THEN '⚠️  ' || count(*) || ' regression(s) detected across logical jobs:'
   ELSE 'No runtime regressions detected against current baselines.' END FROM worst
 UNION ALL SELECT 2, rank, first_pos, 0, 0, '- ' || job_id || ' (latest run ' || run_identifier || ') on cluster ' || cluster_name || ': ' || message
   || CASE WHEN b_p50_duration <> 0 AND b_run_count <> 0 THEN format(' (baseline median {{:.1f}}s over {{}} runs)', b_p50_duration, b_run_count) ELSE '' END FROM worst
 UNION ALL SELECT 3, 0, 0, 0, 0, '' WHERE EXISTS (SELECT 1 FROM worst)
 UNION ALL SELECT 3, 1, 0, 0, 0, 'Suggested actions:' WHERE EXISTS (SELECT 1 FROM worst)
 UNION ALL SELECT 4, l, a, b, c, '- ' || job_id || ': ' || action FROM firsts WHERE rn = 1
 UNION ALL SELECT 5, 0, 0, 0, 0, ''
 UNION ALL SELECT 5, 1, 0, 0, 0, 'Recent job highlights:'
 UNION ALL SELECT 6, fact_pos, 0, 0, 0, '- ' || run_identifier || ' (SPARK) state=' || job_state || ' duration=' || duration FROM highlighted
 UNION ALL SELECT 6, fact_pos, 1, 0, 0, '  resource usage: vcore_seconds=' || coalesce(vcore_text, 'None') || ' memory_gb_seconds=' || coalesce(memory_text, 'None')
   FROM highlighted WHERE coalesce(vcore_text, memory_text) IS NOT NULL)
SELECT row_number() OVER (ORDER BY s, a, b, c, d) AS line_no, line FROM lines""")
def report_text(spark, sf):
    return R.numbered_lines(_outcomes(spark, sf))


# Facts do not hold the run date: runs without times are placed by their ingest date.
_STORED = ORACLES["report_text"]


@query(_STORED)
def stored_report(spark, sf):
    """The report over facts that were written to a table and read back, without any run."""
    folder = f"{shared_folder(spark).rstrip('/')}/facts-{datetime.now().timestamp():.6f}"
    history.append_facts(_facts(spark, sf), folder, as_path=True)
    stored = history.read_facts(spark, folder)
    number = F.regexp_extract("driver_log_excerpt", r"(\d+)$", 1)
    dates = _runs(spark, sf).select(F.concat(F.lit("logs/"), text("run_no")).alias("log"), "run_date")
    dated = stored.join(dates, F.col("driver_log_excerpt") == F.col("log"), "left")
    kept = stored_outcomes(dated, AS_OF, AS_OF, uid=number, run_date=F.col("run_date"))
    return R.numbered_lines(kept)


# Functions named with a trailing underscore only avoid an import of the same name.
QUERIES = {name.rstrip("_"): fn for name, fn in QUERIES.items()}
ORACLES = {name.rstrip("_"): sql for name, sql in ORACLES.items()}
