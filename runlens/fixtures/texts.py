"""SQL of the derived inputs. ``$name`` stands for a table or an engine difference."""

TEXTS: dict[str, str] = {}

# JSON of an order line as a job and as a stage; ``$line`` is what its columns belong to.
JOB = """'{"job_id":' || CAST(${line}l_linenumber - 1 AS STRING) || ',"job_name":"part' || CAST(${line}l_partkey AS STRING)
   || '","num_tasks":' || CAST(CAST(${line}l_quantity AS BIGINT) AS STRING)
   || ',"p95_task_duration_ms":' || CAST(1000 + ${line}l_partkey % 900 AS STRING)
   || ',"max_task_duration_ms":' || CAST(2000 + ${line}l_suppkey % 900 AS STRING)
   || ',"max_over_median_ratio":' || CASE WHEN ${line}l_partkey % 23 = 0 THEN '"n/a"'
        WHEN ${line}l_partkey % 19 = 0 THEN '5.' || CAST(${line}l_partkey % 10 AS STRING)
        WHEN ${line}l_partkey % 11 = 0 THEN '3.' || CAST(${line}l_partkey % 10 AS STRING)
        ELSE '1.' || CAST(${line}l_partkey % 10 AS STRING) END || '}'"""
STAGE = """'{"stage_id":' || CAST(${line}l_linenumber - 1 AS STRING) || ',"name":"st' || CAST(${line}l_suppkey AS STRING)
   || '","num_tasks":' || CAST(CAST(${line}l_quantity AS BIGINT) AS STRING)
   || ',"max_task_duration_ms":' || CAST(2000 + ${line}l_suppkey % 900 AS STRING)
   || ',"p95_task_duration_ms":' || CAST((1000 + ${line}l_partkey % 900) * (${line}l_linenumber % 3) AS STRING) || '}'"""

TEXTS["run_state"] = """
WITH l AS (
 $order_lines),
 o AS (SELECT *, (100 + (o_custkey % 50) * 10) * CASE WHEN o_orderkey % 10 = 7 THEN 25
                 WHEN o_orderkey % 10 = 3 THEN 16 ELSE 10 END AS dur_ds FROM $orders)
SELECT o_orderkey AS run_no,
  CAST(o_orderdate AS DATE) AS run_date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) END AS application_start_time,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL
       WHEN o_orderkey % 37 = 0 THEN o_orderdate - INTERVAL '1' SECOND * 60
       ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400 + CAST(dur_ds / 10 AS BIGINT)) END AS application_end_time,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE NULL END AS status,
  CASE WHEN o_orderkey % 41 = 0 THEN '  ' ELSE ' cluster-' || CAST(c_nationkey AS STRING) || ' ' END AS dataproc_jobid,
  'uuid-' || CAST(c_nationkey AS STRING) AS dataproc_cluster_uuid,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'fam' || CAST(o_custkey % 150 AS STRING) || '_daily'
    || CASE WHEN o_orderkey % 7 = 0 THEN '_ABCDEF' ELSE '_' || lpad(CAST(o_orderkey AS STRING), 7, '0') || 'ab' END END AS spark_jobid,
  CASE WHEN o_orderkey % 26 = 0 THEN NULL
       ELSE 'task' || CAST(o_custkey % 150 AS STRING) || '_' || lpad(CAST(o_orderkey AS STRING), 8, '0') END AS spark_taskid,
  CASE WHEN o_orderkey % 52 = 0 THEN NULL
       ELSE 'application_' || CAST(1700000000 + o_custkey % 150 AS STRING) || '_0001' END AS application_id,
  'logs/' || CAST(o_orderkey AS STRING) AS log_location,
  CASE WHEN o_orderkey % 43 = 0 THEN '{bad' WHEN o_orderkey % 47 = 0 THEN NULL
       ELSE '{"config":{"workerConfig":{"numInstances":' || CAST(4 + o_custkey % 5 AS STRING)
         || ',"machineTypeUri":"n2-standard-4"},"secondaryWorkerConfig":{"numInstances":"' || CAST(o_custkey % 3 AS STRING)
         || '"}' || CASE WHEN o_custkey % 2 = 0 THEN ',"autoscalingConfig":{"policyUri":"p"}' ELSE '' END || '}}' END AS cluster_config_details,
  CASE WHEN o_orderkey % 53 = 0 THEN '[1]' WHEN o_orderkey % 59 = 0 THEN NULL
       WHEN o_orderkey % 61 = 0 THEN 'null' WHEN o_orderkey % 67 = 0 THEN '{bad'
       ELSE CASE WHEN o_orderkey % 71 = 0 THEN chr(10) WHEN o_orderkey % 73 = 0 THEN chr(9) ELSE '' END || '{"app":{"app_id":"a' || CAST(o_orderkey AS STRING)
         || '","app_vcore_seconds":' || CAST(dur_ds * CASE WHEN o_orderkey % 19 = 0 THEN 8 ELSE 4 END AS STRING)
         || ',"app_memory_gb_seconds":"' || CAST(dur_ds * 16 AS STRING)
         || '","executor_peak":' || CAST(o_orderkey % 11 AS STRING)
         || '},"jobs":[' || coalesce($jobs, '') || '],"stages":[' || coalesce($stages, '') || ']}' END AS spark_event_metrics
FROM $orders_with_lines
"""

TEXTS["log_entries"] = """
SELECT event_id, ts AS timestamp,
  CASE WHEN event_id % 3 = 0 THEN 'cloud_dataproc_worker' ELSE 'cloud_dataproc_cluster' END AS resource_type,
  CASE WHEN event_id % 3 = 0 THEN 'ContainerExecutor' WHEN event_id % 2 = 0 THEN 'Driver' ELSE 'Other' END AS logger,
  'cluster-' || CAST(user_id % 5 AS STRING) AS cluster_name,
  'application_' || CAST(user_id % 7 AS STRING) AS yarn_application_id,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS text_payload,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS message
FROM $events
"""

TEXTS["metric_values"] = """
SELECT event_id, ts AS end_time,
  'dataproc.googleapis.com/' || CASE event_id % 6 WHEN 0 THEN 'cluster/yarn/memory_utilization'
       WHEN 1 THEN 'cluster/hdfs/percent_used' WHEN 2 THEN 'cluster/cpu/utilization'
       WHEN 3 THEN 'agent/worker/idle_cores' WHEN 4 THEN 'job/runtime'
       ELSE 'job/stage_elapsed_time' END AS metric_type,
  CASE WHEN event_id % 6 < 4 THEN 'cloud_dataproc_cluster' ELSE 'cloud_dataproc_job' END AS resource_type,
  'cluster-' || CAST(user_id % 5 AS STRING) AS cluster_name,
  'job-' || CAST(user_id % 8 AS STRING) AS job_id,
  CASE WHEN user_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS region,
  CASE WHEN event_id % 5 IN (0, 1) THEN value ELSE NULL END AS double_value,
  CASE WHEN event_id % 5 = 2 THEN CAST(floor(value) AS BIGINT) ELSE NULL END AS int64_value,
  CASE WHEN event_id % 5 = 3 THEN event_id % 7 ELSE NULL END AS distribution_count
FROM $events
"""

TEXTS["job_snapshots"] = """
SELECT o_orderkey AS job_no,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'job-' || CAST(o_orderkey AS STRING) END AS ref_job_id,
  'uuid-' || CAST(o_orderkey AS STRING) AS job_uuid,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS state_start_time,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate - INTERVAL '1' SECOND * 30 END AS first_history_time,
  o_orderstatus AS state,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'application_' || CAST(o_orderkey AS STRING) END AS app_id,
  'name-' || CAST(o_orderkey AS STRING) AS app_name
FROM $orders
"""

TEXTS["daily_facts"] = """
SELECT CAST(coalesce(application_end_time, application_start_time) AS DATE) AS ingest_date,
  coalesce(application_end_time, application_start_time) AS ingest_timestamp,
  'demo-project' AS project_id, 'r1' AS region,
  CASE WHEN trim(dataproc_jobid) = '' THEN 'unknown' ELSE trim(dataproc_jobid) END AS cluster_name,
  spark_jobid AS job_id,
  'SPARK' AS job_type, coalesce(status, 'UNKNOWN') AS job_state,
  application_start_time AS job_start_time, application_end_time AS job_end_time,
  CASE WHEN application_start_time IS NULL OR application_end_time IS NULL THEN NULL
       ELSE greatest($run_seconds, CAST(0 AS DOUBLE)) END AS duration_seconds,
  $app_ids AS yarn_application_ids,
  cluster_config_details AS cluster_metrics, spark_event_metrics AS job_metrics,
  log_location AS driver_log_excerpt, CAST(NULL AS STRING) AS yarn_log_excerpt,
  CAST(NULL AS STRING) AS spark_event_snippet, CAST(NULL AS STRING) AS anomaly_flags
FROM $run_state
WHERE spark_jobid IS NOT NULL
  AND coalesce(application_end_time, application_start_time) < TIMESTAMP '2000-01-01 00:00:00'
  AND CAST(regexp_extract(spark_jobid, 'fam([0-9]+)_', 1) AS INT) >= 60
"""

TEXTS["clusters"] = """
SELECT c_custkey AS cluster_no,
  'cluster-' || CAST(c_custkey AS STRING) AS cluster_name,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'uuid-' || CAST(c_custkey AS STRING) END AS cluster_uuid,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'RUNNING' END AS state,
  last_order AS state_start_time,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE first_order END AS first_history_time,
  c_mktsegment AS segment,
  c_custkey % 100 AS capacity,
  c_custkey % 11 AS pending,
  '2.' || CAST(c_nationkey % 3 AS STRING) AS image_version
FROM $customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
  FROM $orders GROUP BY o_custkey) o ON o_custkey = c_custkey
"""

TEXTS["event_log_files"] = """
SELECT doc_id,
  'logs/' || CASE WHEN doc_id % 4 < 2 THEN 'application_' || CAST(1700000000 + doc_id % 150 AS STRING) || '_0001/part_'
    WHEN doc_id % 4 = 2 THEN 'job_' || CAST(doc_id % 40 AS STRING) || '_'
    ELSE 'stderr_' END || CAST(doc_id AS STRING) AS name,
  text
FROM $documents
"""
