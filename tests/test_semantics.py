"""Threshold edges and the behaviours that are easy to miss, on literal frames."""

from datetime import date, datetime

import pytest
from frames import run, runs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import clock, identity
from runlens.functions import metrics as M
from runlens.functions import variant as V
from runlens.functions.wording import fixed, shortest
from runlens.operators import report as R
from runlens.operators.baseline import historical_baseline
from runlens.operators.detect import add_findings
from runlens.operators.facts import fact_rows, outcomes
from runlens.operators.profile import profile_runs
from runlens.params import Params
from runlens.schema import BASELINE_FIELDS, BASELINE_SCHEMA
from runlens.sources.history import decode_facts, scan_history
from runlens.storage import pin

PARAMS = Params("p", "r1", dry_run=True)
AS_OF = datetime(2024, 1, 2)


def found(spark, rows, **baseline):
    """Profiled runs with one given baseline (none if no field is given), and findings."""
    profiled = profile_runs(runs(spark, *rows), uid="run_no")
    kind = T.StructType([f for f in BASELINE_SCHEMA.fields if f.name != "job_id"])
    b = F.struct(
        *(F.lit(baseline.get(n)).cast(kind[n].dataType).alias(n) for n in BASELINE_FIELDS)
    )
    with_baseline = profiled.withColumn("baseline", b if baseline else F.lit(None).cast(kind))
    return add_findings(with_baseline)


def kinds(frame):
    return {
        int(r["uid"]): [(f["kind"], f["severity"]) for f in r["findings"]] for r in frame.collect()
    }


def timed(no, seconds, **kw):
    start = datetime(2024, 1, 1)
    return run(
        no, application_start_time=start,
        application_end_time=datetime.fromtimestamp(start.timestamp() + seconds), **kw,
    )


def test_runtime_edges(spark):
    rows = [timed(1, 149), timed(2, 150), timed(3, 199), timed(4, 200), timed(5, 0)]
    got = kinds(found(spark, rows, p50_duration=100.0, run_count=3))
    k = "job_runtime_regression"
    assert got == {1: [], 2: [(k, "warning")], 3: [(k, "warning")], 4: [(k, "critical")], 5: []}
    assert kinds(found(spark, rows, p50_duration=0.0)) == dict.fromkeys(range(1, 6), [])
    assert kinds(found(spark, rows)) == dict.fromkeys(range(1, 6), [])


def test_straggler_edges(spark):
    def job(r):
        return {"spark_event_metrics": {"jobs": [1, {"job_id": 7, "max_over_median_ratio": r}]}}

    rows = [run(1, **job(3.0)), run(2, **job("3.01")), run(3, **job(5.0)), run(4, **job("x")), run(5)]
    k = "task_straggler_detected"
    assert kinds(found(spark, rows)) == {1: [], 2: [(k, "warning")], 3: [(k, "critical")], 4: [], 5: []}


def test_cost_edges_and_tie(spark):
    def app(vcores, memory):
        return {
            "spark_event_metrics": {
                "app": {"app_vcore_seconds": vcores, "app_memory_gb_seconds": memory}
            }
        }

    rows = [run(1, **app(130, 100)), run(2, **app(131, 100)), run(3, **app(175, 175)), run(4, **app(100, "200"))]
    frame = found(spark, rows, avg_app_vcore_seconds=100.0, avg_app_memory_gb_seconds=100.0)
    k = "cost_regression"
    assert kinds(frame) == {1: [], 2: [(k, "warning")], 3: [(k, "critical")], 4: [(k, "critical")]}
    metric = {
        int(r["uid"]): [f["evidence"]["metric"] for f in r["findings"]] for r in frame.collect()
    }
    assert metric == {1: [], 2: ["vcore_seconds"], 3: ["vcore_seconds"], 4: ["memory_gb_seconds"]}
    assert all(not v for v in kinds(found(spark, rows, avg_app_vcore_seconds=0.0)).values())


def test_rightsizing_edges(spark):
    def sized(peak, workers):
        return {
            "spark_event_metrics": {"app": {"executor_peak": peak}},
            "cluster_config_details": {"config": {"workerConfig": {"numInstances": workers}}},
        }

    rows = [run(1, **sized(9, 20)), run(2, **sized(8.9, 20)), run(3, **sized(19, 20)), run(4, **sized(18.9, 20)), run(5, **sized(5, 0))]
    got = kinds(found(spark, rows))
    assert got == {
        1: [], 2: [("cluster_underutilized", "info")], 3: [("cluster_capacity_near_limit", "warning")], 4: [], 5: [],
    }
    flags = {int(r["uid"]): r["has_issues"] for r in found(spark, rows).collect()}
    assert flags == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_suffix_case_rules(spark):
    df = spark.createDataFrame(
        [("x_ABCDEF",), ("x_abcdef_123456",), ("_abcdef",), ("job_20240101",), ("my_facade",), ("a_12345",)], "id string"
    )
    rows = df.select(
        identity.normalize_identifier(F.col("id")).alias("py"), identity.logical_id(F.col("id")).alias("sql")
    ).collect()
    assert [r["py"] for r in rows] == ["x", "x_abcdef", "", "job", "my", "a_12345"]
    assert [r["sql"] for r in rows] == ["x_ABCDEF", "x_abcdef", "_abcdef", "job", "my", "a_12345"]


def test_twice_stripped_family_is_never_found(spark):
    """A stored id is stripped again by the history, so this family has no baseline."""
    facts = spark.createDataFrame(
        [(date(2024, 1, 1), datetime(2024, 1, 1), "x_abcdef", "SPARK", "c", 5.0, None)],
        "ingest_date date, ingest_timestamp timestamp_ntz, job_id string, job_type string, cluster_name string,"
        " duration_seconds double, job_metrics string",
    )
    rows = historical_baseline(scan_history(facts, datetime(2023, 12, 30), datetime(2024, 1, 2))).collect()
    assert [r["job_id"] for r in rows] == ["x"]


def test_history_upper_rank_is_the_ninetieth(spark):
    rows = spark.range(1, 101).select(
        F.lit("j").alias("job_id"), F.lit("SPARK").alias("job_type"), F.lit("c").alias("cluster_name"),
        F.col("id").cast("double").alias("duration_seconds"),
        *(F.lit(None).cast("double").alias(c) for c in (
            "app_vcore_seconds", "app_memory_gb_seconds", "max_over_median_ratio", "p95_task_duration_ms")),
    )
    assert historical_baseline(rows).first()["p95_duration"] == 90.0
    assert historical_baseline(rows, upper_rank=0.95).first()["p95_duration"] == 95.0


def test_falsy_zero(spark):
    doc = {
        "jobs": [{"job_id": 0, "max_over_median_ratio": 9}],
        "stages": [
            {"stage_id": 0, "max_task_duration_ms": 900},
            {"stage_id": 0, "stageId": 4, "max_task_duration_ms": 0, "maxTaskDurationMs": 50, "p95_task_duration_ms": 0},
            {"stage_id": "0", "name": "", "stage_name": "n", "max_task_duration_ms": "0", "maxTaskDurationMs": 70},
            {"stageId": 0, "max_task_duration_ms": 10},
            "text", None, 5,
        ],
    }
    frame = runs(spark, run(1, spark_event_metrics=doc)).select(V.parse(F.col("spark_event_metrics")).alias("v"))
    stages = frame.select(M.stage_rows(F.col("v")).alias("s")).first()["s"]
    assert [(s["stage_id"], s["name"], s["max_task_duration_ms"], s["p95_task_duration_ms"]) for s in stages] == [
        ("4", None, 50.0, None), ("0", "n", 0.0, None), ("0", None, 10.0, None),
    ]
    finding = found(spark, [run(1, spark_event_metrics=doc)]).first()["findings"][0]
    assert finding["evidence"]["job_id"] == "etl_daily"
    assert finding["evidence"]["stage"]["stage_id"] == "4"
    assert finding["message"].endswith("has max task 50.0ms vs median Nonems.")


def test_worst_choices_take_the_first_on_ties(spark):
    doc = {
        "jobs": [{"job_name": n, "max_over_median_ratio": r} for n, r in (("a", 4), ("b", 6), ("c", 6))],
        "stages": [{"stage_id": i, "max_task_duration_ms": m, "p95_task_duration_ms": p} for i, m, p in ((1, 10, 5), (2, 20, 40), (3, 20, None))],
    }
    finding = found(spark, [run(1, spark_event_metrics=doc)]).first()["findings"][0]
    assert finding["message"].startswith("Spark job b shows task skew (max/median ratio 6.00).")
    assert finding["evidence"]["stage"]["stage_id"] == "1"


def test_rounding_follows_the_binary_value(spark):
    df = spark.createDataFrame([(0.25,), (1.005,), (0.125,), (2.5,), (12345678.9,)], "x double")
    got = df.select(fixed(F.col("x"), 1), fixed(F.col("x"), 2), fixed(F.col("x"), 0), shortest(F.col("x"))).collect()
    for row, x in zip(got, (0.25, 1.005, 0.125, 2.5, 12345678.9)):
        assert tuple(row) == (f"{x:.1f}", f"{x:.2f}", f"{x:.0f}", str(x))


def test_duration_and_time_types(spark):
    df = runs(
        spark,
        run(1, application_end_time=datetime(2023, 12, 31)),
        run(2, application_start_time=None),
        run(3, application_end_time=None),
    )
    d = clock.duration_seconds(F.col("application_start_time"), F.col("application_end_time"))
    assert [r[0] for r in df.select(d).collect()] == [0.0, None, None]
    texts = spark.createDataFrame([("2024-01-01T10:00:00+02:00",), ("2024-01-01 10:00:00",), ("bad",)], "t string")
    assert [r[0] for r in texts.select(clock.utc(texts, "t")).collect()] == [
        datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 10), None,
    ]
    stamps = spark.sql("select timestamp'2024-01-01 10:00:00.5+02:00' t")
    assert stamps.select(clock.iso_utc(clock.utc(stamps, "t"))).first()[0] == "2024-01-01T08:00:00.500000+00:00"


def test_order_key(spark):
    """A date alone sorts before midnight of that day, and nothing at all first."""
    rows = [
        run(1, application_start_time=datetime(2024, 1, 1), application_end_time=None),
        run(2, application_start_time=None, application_end_time=None),
        run(3, application_start_time=None, application_end_time=None, run_date=None),
        run(4, application_start_time=None, application_end_time=datetime(2023, 12, 31)),
    ]
    profiled = profile_runs(runs(spark, *rows), uid="run_no").orderBy(*clock.ORDER)
    assert [r["uid"] for r in profiled.select("uid").collect()] == ["3", "4", "2", "1"]


def test_messy_documents_still_give_facts(spark):
    docs = [None, "", "  ", "{bad", "[1, 2]", "5", "null", '"s"', '{"a": 1}', '{}', '{"metadata": {"job_family": "own"}, "b": 2} ']
    rows = [run(i, spark_event_metrics=d, cluster_config_details=d) for i, d in enumerate(docs)]
    facts = decode_facts(fact_rows(found(spark, rows), PARAMS, AS_OF))
    got = [
        (V.text(F.col(c), p).alias(a))
        for c, p, a in (
            ("job_metrics", "$.metadata.run_identifier", "run"), ("job_metrics", "$.metadata.job_family", "family"),
            ("job_metrics", "$.value", "value"), ("job_metrics", "$.a", "a"), ("job_metrics", "$.b", "b"),
            ("cluster_metrics", "$.cluster_config_details", "cluster"), ("cluster_metrics", "$.cluster_profile", "profile"),
        )
    ]
    out = facts.orderBy("job_start_time").select(*got).collect()
    assert [r["run"] for r in out] == ["etl_daily"] * len(docs)
    assert [r["family"] for r in out] == ["etl_daily"] * 10 + ["own"]
    assert [r["value"] for r in out] == [None] * 4 + ["[1,2]", "5", None, "s", None, None, None]
    assert (out[8]["a"], out[10]["b"]) == ("1", "2")
    assert [r["cluster"] for r in out][:8] == ["{}"] * 3 + ['{"unparsed":"{bad"}', '{"value":[1,2]}', '{"value":5}', "{}", '{"value":"s"}']
    assert all(r["profile"] == '{"autoscaling_enabled":false,"total_workers":0}' for r in out)


def test_profile_numbers(spark):
    def cfg(**worker):
        return {"config": {"workerConfig": worker, "autoscalingConfig": {}}}

    rows = [run(1, cluster_config_details=cfg(numInstances="4")), run(2, cluster_config_details=cfg(numInstances="4.7")),
            run(3, cluster_config_details=cfg(numInstances=4.7, machineTypeUri=""))]
    got = profile_runs(runs(spark, *rows), uid="run_no").orderBy("uid").collect()
    assert [r["cluster_profile"]["primary_workers"] for r in got] == [4, None, 4]
    assert [r["cluster_profile"]["total_workers"] for r in got] == [4, 0, 4]
    assert not any(r["cluster_profile"]["autoscaling_enabled"] for r in got)
    assert got[2]["cluster_profile"]["primary_machine_type"] is None


def test_snippet(spark):
    docs = [
        {"app": {"application_id": "a1", "name": "etl", "duration_ms": 0, "app_vcore_seconds": 1.005}, "jobs": [3, {"num_tasks": None, "max_over_median_ratio": 2}]},
        {"app": {}, "jobs": [{}]},
        {"jobs": []},
        {"app": {"app_name": "x" * 7000}},
    ]
    df = runs(spark, *(run(i, spark_event_metrics=d) for i, d in enumerate(docs)))
    profiled = profile_runs(df, uid="run_no")
    got = [r[0] for r in profiled.orderBy("uid").select(M.event_snippet(F.col("app_doc"), F.col("first_job_doc"), 6000)).collect()]
    whole = profiled.select(F.max(F.length(M.event_snippet(F.col("app_doc"), F.col("first_job_doc"))))).first()[0]
    assert whole > 7000
    assert got[0] == (
        "Application etl (a1) duration=0ms executors=n/a\n"
        "  Resource usage: vcore_seconds=1.00 memory_gb_seconds=None\n"
        "  Job n/a tasks=None duration=n/ams p95=n/ams\n"
        "    Straggler ratio: 2.00"
    )
    assert got[1] is None and got[2] is None and len(got[3]) == 6000


def test_report_order_and_guards(spark):
    slow = {"spark_event_metrics": {"jobs": [{"job_id": 1, "max_over_median_ratio": 9}]}}
    mild = {"spark_event_metrics": {"jobs": [{"job_id": 1, "max_over_median_ratio": 4}]}}
    rows = [
        run(1, spark_jobid="b", **mild), run(2, spark_jobid="a", **slow), run(3, spark_jobid="b", **slow),
        run(4, spark_jobid="b", **slow), run(5, spark_jobid="c"), run(6, spark_jobid="d", status=None),
    ]
    out = pin(outcomes(found(spark, rows)))
    lines = list(R.iter_lines(out))
    assert lines[2] == "Jobs ingested: 6 (states: SUCCEEDED=5, UNKNOWN=1)"
    # Both are critical: b was seen first, and its first critical run is the one named.
    assert lines[4].endswith("2 regression(s) detected across logical jobs:")
    assert lines[5].startswith("- b (latest run b) on cluster unknown") and lines[6].startswith("- a ")
    assert [r["run_identifier"] for r in R.highlights(out).collect()] == ["b", "a", "b", "b", "c"]
    assert [r["uid"] for r in R.highlights(out, newest=True).collect()] == ["6", "5", "4", "3", "2"]
    worst = {r["job_id"]: r["uid"] for r in R.worst_findings(out).collect()}
    assert worst == {"a": "2", "b": "3"}
    quiet = list(R.iter_lines(out.where("job_id in ('c', 'd')")))
    assert quiet[4] == "No runtime regressions detected against current baselines."
    assert len(list(R.iter_lines(out.where("false")))) == 1
    numbered = R.numbered_lines(out).orderBy("line_no").collect()
    assert [r["line"] for r in numbered] == lines


@pytest.mark.parametrize("text,want", [("1_0", None), ("abc", None), ("NaN", None), ("2.5", 2.5), ("1e2", 100.0)])
def test_number_reading(spark, text, want):
    df = spark.createDataFrame([(f'{{"x": "{text}"}}',)], "d string")
    assert df.select(V.number(V.parse(F.col("d")), "$.x")).first()[0] == want
