"""Shared DuckDB pieces of the oracle texts, written from the semantics, not from the
Spark expressions."""

WINDOW = """win AS (SELECT * FROM run_state
  WHERE application_start_time BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-06-29'
     OR (application_start_time IS NULL AND run_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-29'))"""


def profile(source: str) -> str:
    def strip(c: str) -> str:
        return f"nullif(regexp_replace(coalesce({c}, ''), '_[0-9a-f]{{6,}}$', '', 'i'), '')"

    return f"""ids AS (SELECT *,
  {strip('spark_jobid')} AS n1, {strip('spark_taskid')} AS n2, {strip('application_id')} AS n3,
  coalesce(nullif(spark_jobid, ''), nullif(application_id, ''), nullif(spark_taskid, ''), '') AS run_identifier,
  CASE WHEN json_valid(spark_event_metrics) THEN spark_event_metrics END AS mj,
  CASE WHEN json_valid(cluster_config_details) THEN cluster_config_details END AS cj,
  CASE WHEN application_start_time IS NOT NULL AND application_end_time IS NOT NULL
    THEN greatest((epoch_us(application_end_time) - epoch_us(application_start_time)) / 1e6, 0) END AS dur
 FROM {source}),
prof AS (SELECT *,
  coalesce(n1, n2, n3, '') AS family,
  coalesce(n1, n2, n3, run_identifier) AS job_id,
  coalesce(nullif(trim(dataproc_jobid), ''), 'unknown') AS cluster_name,
  coalesce(nullif(status, ''), 'UNKNOWN') AS job_state,
  try_cast(json_extract_string(mj, '$.app.app_vcore_seconds') AS DOUBLE) AS vcores,
  try_cast(json_extract_string(mj, '$.app.app_memory_gb_seconds') AS DOUBLE) AS memory,
  try_cast(json_extract_string(mj, '$.app.executor_peak') AS DOUBLE) AS peak,
  try_cast(json_extract_string(mj, '$.jobs[0].max_over_median_ratio') AS DOUBLE) AS ratio0,
  try_cast(json_extract_string(mj, '$.jobs[0].p95_task_duration_ms') AS DOUBLE) AS p95_0,
  coalesce(try_cast(json_extract_string(cj, '$.config.workerConfig.numInstances') AS BIGINT), 0)
   + coalesce(try_cast(json_extract_string(cj, '$.config.secondaryWorkerConfig.numInstances') AS BIGINT), 0) AS workers,
  coalesce(strftime(application_start_time, '%Y-%m-%dT%H:%M:%S'), strftime(application_end_time, '%Y-%m-%dT%H:%M:%S'),
    CAST(run_date AS VARCHAR), '') AS k1,
  coalesce(strftime(application_end_time, '%Y-%m-%dT%H:%M:%S'), CAST(run_date AS VARCHAR), '') AS k2,
  CAST(run_no AS VARCHAR) AS uid
 FROM ids),
sampled AS (SELECT *, coalesce(dur, vcores, memory, ratio0, p95_0) IS NOT NULL AS has FROM prof)"""


JOBS = """jobs AS (SELECT run_no, i, j, CASE WHEN try_cast(json_extract_string(j, '$.max_over_median_ratio') AS DOUBLE) > 3
    THEN try_cast(json_extract_string(j, '$.max_over_median_ratio') AS DOUBLE) END AS r
  FROM (SELECT run_no, unnest(js) AS j, generate_subscripts(js, 1) - 1 AS i
    FROM (SELECT run_no, json_extract(mj, '$.jobs[*]') AS js FROM prof) a) b)"""

STAGES = """stages0 AS (SELECT run_no, i, json_extract_string(s, '$.stage_id') AS sid, json_extract_string(s, '$.name') AS sname,
    try_cast(json_extract_string(s, '$.num_tasks') AS BIGINT) AS tasks,
    try_cast(json_extract_string(s, '$.max_task_duration_ms') AS DOUBLE) AS longest,
    try_cast(json_extract_string(s, '$.p95_task_duration_ms') AS DOUBLE) AS p95_raw
  FROM (SELECT run_no, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i
    FROM (SELECT run_no, json_extract(mj, '$.stages[*]') AS ss FROM prof) a) b),
-- A numeric zero id has no camel-case fallback here, so the stage is dropped; a zero p95 falls
-- through to the absent camel-case field.
stages AS (SELECT run_no, i, sid AS stage_id, sname AS name, tasks AS num_tasks, longest AS max_ms,
    CASE WHEN p95_raw = 0 THEN NULL ELSE p95_raw END AS p95_ms FROM stages0 WHERE sid <> '0')"""

WORST = """worst_job AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY r DESC, i) AS rn
    FROM jobs WHERE r IS NOT NULL) x WHERE rn = 1),
worst_stage AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_no
    ORDER BY max_ms * CASE WHEN max_ms / p95_ms > 1 THEN max_ms / p95_ms ELSE 1 END DESC, i) AS rn
    FROM stages WHERE max_ms IS NOT NULL) x WHERE rn = 1)"""

HISTORY = """raw_history AS (SELECT job_id, job_type, cluster_name, duration_seconds,
    try_cast(json_extract_string(doc, '$.app.app_vcore_seconds') AS DOUBLE) AS vcores,
    try_cast(json_extract_string(doc, '$.app.app_memory_gb_seconds') AS DOUBLE) AS memory,
    try_cast(json_extract_string(doc, '$.jobs[0].max_over_median_ratio') AS DOUBLE) AS ratio,
    try_cast(json_extract_string(doc, '$.jobs[0].p95_task_duration_ms') AS DOUBLE) AS p95
  FROM (SELECT *, CASE WHEN json_valid(job_metrics) THEN job_metrics END AS doc FROM daily_facts) f
  WHERE ingest_timestamp BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-06-29' AND duration_seconds IS NOT NULL),
logical AS (SELECT *, CASE WHEN regexp_replace(job_id, '_[0-9a-f]{6,}$', '') <> ''
    THEN regexp_replace(job_id, '_[0-9a-f]{6,}$', '') ELSE job_id END AS logical_id FROM raw_history),
hist AS (SELECT logical_id AS job_id, min(job_type) AS job_type, min(cluster_name) AS cluster_name,
    quantile_disc(duration_seconds, 0.5) AS p50_duration, quantile_disc(duration_seconds, 0.9) AS p95_duration,
    avg(duration_seconds) AS avg_duration,
    quantile_disc(vcores, 0.5) AS p50_vcore, quantile_disc(vcores, 0.9) AS p95_vcore, avg(vcores) AS avg_vcore,
    quantile_disc(memory, 0.5) AS p50_memory, quantile_disc(memory, 0.9) AS p95_memory, avg(memory) AS avg_memory,
    avg(ratio) AS avg_ratio, quantile_disc(p95, 0.9) AS p95_task, count(*) AS run_count
  FROM logical GROUP BY logical_id)"""

RUNNING = """running AS (SELECT run_no, job_id,
    count(CASE WHEN has THEN 1 END) OVER w AS run_count,
    last_value(CASE WHEN has THEN cluster_name END IGNORE NULLS) OVER w AS cluster_name,
    quantile_cont(dur, 0.5) OVER w AS p50_duration, quantile_cont(dur, 0.95) OVER w AS p95_duration,
    avg(dur) OVER w AS avg_duration,
    quantile_cont(vcores, 0.5) OVER w AS p50_vcore, quantile_cont(vcores, 0.95) OVER w AS p95_vcore,
    avg(vcores) OVER w AS avg_vcore,
    quantile_cont(memory, 0.5) OVER w AS p50_memory, quantile_cont(memory, 0.95) OVER w AS p95_memory,
    avg(memory) OVER w AS avg_memory,
    avg(ratio0) OVER w AS avg_ratio, quantile_cont(p95_0, 0.95) OVER w AS p95_task
  FROM sampled WHERE job_id <> ''
  WINDOW w AS (PARTITION BY job_id ORDER BY k1, k2, run_identifier, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_STATS = ("p50_duration", "p95_duration", "avg_duration", "p50_vcore", "p95_vcore", "avg_vcore",
          "p50_memory", "p95_memory", "avg_memory", "avg_ratio", "p95_task", "run_count")

RESOLVED = (
    "resolved AS (SELECT s.*, CASE WHEN h.job_id IS NOT NULL THEN 'history' WHEN r.run_no IS NOT NULL THEN 'batch' "
    "ELSE 'none' END AS source, "
    + ", ".join(f"CASE WHEN h.job_id IS NOT NULL THEN h.{c} ELSE r.{c} END AS b_{c}" for c in _STATS)
    + ", CASE WHEN h.job_id IS NOT NULL THEN h.cluster_name ELSE r.cluster_name END AS b_cluster"
    " FROM sampled s LEFT JOIN hist h ON h.job_id = s.job_id"
    " LEFT JOIN running r ON r.run_no = s.run_no AND r.run_count > 0)"
)

# Findings in long form: one row per run and detector, ``pos`` in detector order.
FINDINGS = """cost0 AS (SELECT run_no,
    CASE WHEN b_avg_vcore > 0 AND vcores / b_avg_vcore > 1.3 THEN vcores / b_avg_vcore END AS rv,
    CASE WHEN b_avg_memory > 0 AND memory / b_avg_memory > 1.3 THEN memory / b_avg_memory END AS rm FROM resolved),
cost AS (SELECT r.*, CASE WHEN coalesce(rv, 0) >= coalesce(rm, 0) THEN 'vcore_seconds' ELSE 'memory_gb_seconds' END AS metric,
    CASE WHEN coalesce(rv, 0) >= coalesce(rm, 0) THEN vcores ELSE memory END AS cur,
    CASE WHEN coalesce(rv, 0) >= coalesce(rm, 0) THEN b_avg_vcore ELSE b_avg_memory END AS base,
    greatest(coalesce(rv, 0), coalesce(rm, 0)) AS ratio
  FROM resolved r JOIN cost0 c ON c.run_no = r.run_no WHERE rv IS NOT NULL OR rm IS NOT NULL),
strag AS (SELECT r.*, w.r AS ratio, w.i AS job_pos, CASE WHEN json_extract_string(w.j, '$.job_id') = '0' THEN r.job_id
      ELSE json_extract_string(w.j, '$.job_id') END AS spark_job,
    json_extract_string(w.j, '$.job_name') AS job_name,
    t.stage_id, t.name AS stage_name, t.max_ms, t.p95_ms, t.num_tasks
  FROM resolved r JOIN worst_job w ON w.run_no = r.run_no LEFT JOIN worst_stage t ON t.run_no = r.run_no),
used AS (SELECT *, peak / workers AS u FROM resolved WHERE workers > 0 AND peak IS NOT NULL),
findings AS (
 SELECT run_no, 0 AS pos, 'job_runtime_regression' AS kind,
   CASE WHEN dur / b_p50_duration >= 2 THEN 'critical' ELSE 'warning' END AS severity,
   format('Runtime {:.1f}s vs baseline median {:.1f}s (+{:.1f}s, {:.1f}x slower).', dur, b_p50_duration,
     dur - b_p50_duration, dur / b_p50_duration) AS message,
   'Review recent code/input changes and examine the heaviest Spark stages; consider optimising joins or repartitioning to recover the baseline runtime.' AS action
 FROM resolved WHERE dur > 0 AND b_p50_duration <> 0 AND dur / b_p50_duration >= 1.5
 UNION ALL
 SELECT run_no, 1, 'task_straggler_detected', CASE WHEN ratio >= 5 THEN 'critical' ELSE 'warning' END,
   format('Spark job {} shows task skew (max/median ratio {:.2f}).', coalesce(job_name, spark_job), ratio)
   || CASE WHEN stage_id IS NULL THEN '' ELSE ' Most affected stage ' || stage_id || ' (' || stage_name || ') has max task '
     || CAST(max_ms AS VARCHAR) || 'ms vs median ' || coalesce(CAST(p95_ms AS VARCHAR), 'None') || 'ms.' END,
   CASE WHEN stage_id IS NULL THEN 'Investigate skewed partitions within this job; adjust partitioning or salt skewed keys to balance task runtimes.'
     ELSE 'Target stage ' || stage_id || ' (' || stage_name || ') — repartition or salt the skewed key and review shuffle parallelism to balance task runtimes.' END
 FROM strag
 UNION ALL
 SELECT run_no, 2, 'cost_regression', CASE WHEN ratio < 1.75 THEN 'warning' ELSE 'critical' END,
   format('{} {:.1f} vs avg {:.1f} (+{:.1f}, {:.2f}x).', replace(metric, '_', ' '), cur, base, cur - base, ratio),
   format('Review executor sizing and input volume; {} rose {:.2f}x over baseline.', replace(metric, '_', ' '), ratio)
 FROM cost
 UNION ALL
 SELECT run_no, 3, CASE WHEN u < 0.45 THEN 'cluster_underutilized' ELSE 'cluster_capacity_near_limit' END,
   CASE WHEN u < 0.45 THEN 'info' ELSE 'warning' END,
   CASE WHEN u < 0.45 THEN format('Cluster {} used only {:.0f}% of provisioned workers (peak executors {:.1f} vs {}).', cluster_name, u * 100, peak, workers)
     ELSE format('Cluster {} saturated provisioned workers (peak executors {:.1f} vs {}).', cluster_name, peak, workers) END,
   CASE WHEN u < 0.45 THEN 'Right-size the cluster: consider reducing worker count or enabling autoscaling to match observed executor demand.'
     ELSE 'Consider increasing worker capacity or enabling autoscaling to prevent executor saturation.' END
 FROM used WHERE u < 0.45 OR u >= 0.95),
flagged AS (SELECT r.*, coalesce(f.has_issues, FALSE) AS has_issues, coalesce(f.kinds, '') AS kinds,
    coalesce(f.n, 0) AS n_findings
  FROM resolved r LEFT JOIN (SELECT run_no, bool_or(severity IN ('warning', 'critical')) AS has_issues,
    string_agg(kind || ':' || severity, ',' ORDER BY pos) AS kinds, count(*) AS n FROM findings GROUP BY run_no) f
  ON f.run_no = r.run_no)"""

# The finding rows of runs with an issue, with processing position and rank.
ISSUES = """placed AS (SELECT *, row_number() OVER (ORDER BY k1, k2, run_identifier, uid) AS fact_pos FROM flagged),
issue_rows AS (SELECT p.*, f.pos, f.kind, f.severity, f.message, f.action,
    CASE f.severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS rank
  FROM placed p JOIN findings f ON f.run_no = p.run_no WHERE p.has_issues),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rank, fact_pos, pos) AS rn,
    min(fact_pos) OVER (PARTITION BY job_id) AS first_pos FROM issue_rows) x WHERE rn = 1)"""

FULL = ",\n".join([WINDOW, profile("win"), JOBS, STAGES, WORST, HISTORY, RUNNING, RESOLVED, FINDINGS])
REPORT = FULL + ",\n" + ISSUES
