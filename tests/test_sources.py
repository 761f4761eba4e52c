"""Sinks, guards, readers and the size-checked join."""

from datetime import date, datetime, timedelta

import pytest
from frames import run, runs
from pyspark.sql import functions as F

from runlens import fixed as X
from runlens.fixtures import AS_OF as FIXTURE_AS_OF
from runlens.fixtures import PARAMS as FIXTURE_PARAMS
from runlens.fixtures import load
from runlens.params import Params
from runlens.plans import monitor
from runlens.schema import FACT_SCHEMA
from runlens.sources import event_logs, history, logs, run_state, series
from runlens.storage import lookup_join, pin

AS_OF = datetime(2024, 1, 2)


def empty_facts(spark):
    return spark.createDataFrame([], FACT_SCHEMA)


def test_scan_window_is_closed_and_uses_dates_without_start(spark):
    rows = [
        run(1, application_start_time=datetime(2024, 1, 1)), run(2, application_start_time=datetime(2024, 1, 2)),
        run(3, application_start_time=datetime(2024, 1, 2, 0, 0, 1)),
        run(4, application_start_time=None, run_date=date(2024, 1, 1)),
        run(5, application_start_time=None, run_date=date(2024, 1, 3)),
        run(6, application_start_time=None, run_date=None),
    ]
    scanned = run_state.scan_runs(
        runs(spark, *rows), datetime(2024, 1, 1), datetime(2024, 1, 2), ordered=True, keep=("run_no",)
    )
    assert [r["run_no"] for r in scanned.collect()] == [2, 1, 4]


def test_zoned_timestamps_do_not_depend_on_the_session(spark):
    table = runs(spark, run(1, application_start_time=datetime(2024, 1, 1, 12))).withColumn(
        "application_start_time", F.expr("timestamp'2024-01-01 23:30:00-02:00'")
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            hit = run_state.scan_runs(table, datetime(2024, 1, 2, 1), datetime(2024, 1, 2, 2), keep=("run_no",))
            assert hit.count() == 1
            assert run_state.scan_runs(table, datetime(2024, 1, 1), datetime(2024, 1, 2, 1)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_steps_write_append_and_report(spark, tmp_path):
    table = runs(spark, *(run(i, spark_jobid=f"etl_{i % 2}") for i in range(6)))
    params = Params("p", "r1")
    target = str(tmp_path / "facts")
    ingested = monitor.ingest(table, params, AS_OF, uid="run_no")
    assert ingested.summary.first()["run_count"] == 6
    args = dict(uid="run_no", target=target, as_path=True)
    memory = monitor.build_memory(ingested, empty_facts(spark), params, AS_OF, **args)
    assert memory.summary == {
        "persisted_rows": 6, "dry_run": False, "has_anomalies": False, "unreadable_runs": 0
    }
    stored = history.read_facts(spark, target)
    assert stored.count() == 6 and stored.schema.names == FACT_SCHEMA.names
    lines = list(monitor.status_report(memory))
    assert lines[2] == "Jobs ingested: 6 (states: SUCCEEDED=6)"
    # A second run adds the rows again, and now finds the first ones as history.
    again = monitor.build_memory(ingested, stored, params, AS_OF, **args)
    assert history.read_facts(spark, target).count() == 12
    assert again.outcomes.where("baseline_runs = 3").count() == 6
    dry = monitor.build_memory(ingested, stored, Params("p", "r1", dry_run=True), AS_OF, **args)
    assert dry.summary["persisted_rows"] == 6 and history.read_facts(spark, target).count() == 12


def test_guards(spark):
    params = Params("p", "r1")
    nothing = monitor.build_memory(None, empty_facts(spark), params, AS_OF, uid="run_no")
    assert nothing.status is monitor.Status.NOT_INGESTED and nothing.summary["persisted_rows"] == 0
    ingested = monitor.ingest(runs(spark, run(1)), params, datetime(2030, 1, 1), uid="run_no")
    empty = monitor.build_memory(ingested, empty_facts(spark), params, AS_OF, uid="run_no")
    assert empty.status is monitor.Status.NO_RUNS
    assert list(monitor.status_report(empty)) == ["no_facts"] == list(monitor.status_report(None))


def test_fact_table_is_checked_and_never_made(spark):
    with pytest.raises(RuntimeError, match="no fact table no_such_facts"):
        history.check_fact_table(spark, "no_such_facts")
    with pytest.raises(RuntimeError, match="duration_seconds"):
        history.check_fact_schema(empty_facts(spark).drop("duration_seconds"))
    assert not spark.catalog.tableExists("no_such_facts")


def test_recent_facts(spark):
    facts = load(spark, "/root/testdata/sf0.001", "daily_facts")
    newest = history.recent_facts(facts, 5, tiebreak=("job_id", "driver_log_excerpt")).collect()
    stamps = [r["ingest_timestamp"] for r in newest]
    assert len(newest) == 5 and stamps == sorted(stamps, reverse=True)


def test_event_log_files(spark, tmp_path):
    root = tmp_path / "exported logs"
    (root / "prod" / "application_1_0001").mkdir(parents=True)
    (root / "prod" / "application_1_0001" / "part0").write_bytes(b"start")
    (root / "prod" / "application_1_0001.inprogress").write_bytes(b"\xff\xfe" + "é".encode() + b"x" * 3000)
    (root / "prod" / "application_12_0001").write_bytes(b"other")
    (root / "prod" / "job_2").write_bytes(b"job")
    (root / "prod" / "stderr_3").write_bytes(b"no hint")
    ids = ["application_1_0001", "application_1", "job_2", "stderr_3", "absent"]
    asked = spark.createDataFrame([(i,) for i in [*ids, None, ""]], "id string")
    got = event_logs.read_event_logs(spark, str(root), asked, prefix="prod/", max_bytes=10).collect()
    assert sorted((r["application_id"], r["blob_name"]) for r in got) == [
        ("application_1", "prod/application_12_0001"),
        ("application_1", "prod/application_1_0001.inprogress"),
        ("application_1", "prod/application_1_0001/part0"),
        ("application_1_0001", "prod/application_1_0001.inprogress"),
        ("application_1_0001", "prod/application_1_0001/part0"),
        ("job_2", "prod/job_2"),
    ]
    # The cap is never below 1,024 bytes, and bytes that are no UTF-8 are replaced.
    big = next(r for r in got if r["blob_name"].endswith("inprogress"))
    assert big["size_bytes"] == 3004
    assert big["content_snippet"] == (b"\xff\xfe" + "é".encode() + b"x" * 1020).decode("utf-8", errors="replace")
    assert big["truncated"] and not any(r["truncated"] for r in got if r is not big and r["size_bytes"] < 1024)
    absent = asked.where("id = 'absent'")
    assert event_logs.read_event_logs(spark, str(root), absent, max_bytes=10).count() == 0
    assert event_logs.read_event_logs(spark, str(root), asked, prefix="nowhere").count() == 0
    assert event_logs.read_event_logs(spark, None, asked).count() == 0
    # Without a cap a file is read whole, in parts.
    parts = event_logs.read_event_logs(spark, str(root), asked, prefix="prod/", part_bytes=1000)
    texts = [r["content_snippet"] for r in parts.where("application_id = 'application_1_0001' and size_bytes = 3004").orderBy("file_part").collect()]
    assert len(texts) == 4 and sum(len(t.encode("utf-8", "replace")) for t in texts) >= 3004 and texts[3] == "x" * 4


def test_event_logs_of_ingested_runs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "application_7").write_bytes(b"seven")
    (tmp_path / "logs" / "application_8").write_bytes(b"eight")
    params = Params("p", "r1", eventlog_bucket=str(tmp_path), eventlog_prefix="logs")
    ingested = monitor.ingest(runs(spark, run(1, application_id="application_7"), run(2)), params, AS_OF, uid="run_no")
    got = monitor.event_logs(spark, ingested, params).collect()
    assert [(r["application_id"], r["content_snippet"], r["truncated"]) for r in got] == [("application_7", "seven", False)]


def test_contents_are_not_shuffled(spark):
    files = spark.createDataFrame([("application_1/x", 3, b"abc")], "name string, length long, content binary")
    ids = spark.createDataFrame([("application_1",)], "id string")
    text = event_logs.select_event_logs(files, ids)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in text.splitlines() if "Exchange" in x and "Broadcast" not in x]


def test_log_line_cap(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), "INFO", "c%d" % (i % 2), None if i % 3 else "t", "m" if i % 2 else None) for i in range(20)]
    entries = spark.createDataFrame(
        rows, "event_id long, timestamp timestamp_ntz, severity string, cluster_name string, text_payload string, message string"
    )
    whole = logs.log_lines(entries, entry_id="event_id", limit=4).orderBy("line_no").collect()
    assert [r["text"] for r in whole] == ["t", "m", "", "t"]
    per = logs.log_lines(entries, entry_id="event_id", limit=4, per="cluster_name")
    assert per.groupBy("cluster_name").count().collect()[0]["count"] == 4 and per.count() == 8
    every = logs.log_lines(entries, entry_id="event_id", per="cluster_name").collect()
    assert sorted((r["cluster_name"], r["line_no"], r["event_id"]) for r in every) == [
        ("c%d" % k, n + 1, 2 * n + k) for k in range(2) for n in range(10)
    ]


@pytest.mark.parametrize("slack", [0, 65_536])
def test_first_lines_are_found_by_counts(spark, monkeypatch, slack):
    """One value has most entries, many at the same moment; moments, values and limits vary."""
    from runlens.operators import ranking

    monkeypatch.setattr(ranking, "_SLACK", slack)
    if not slack:
        monkeypatch.setattr(ranking, "_FEW_GROUPS", 1)
    start = datetime(1969, 12, 31)
    entries = spark.range(900).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 100 != 7, F.timestamp_add(
            "MICROSECOND", F.when(F.col("id") % 2 == 0, 5_000_000_000).otherwise(F.pmod(F.hash("id"), F.lit(10**11))),
            F.lit(start).cast("timestamp_ntz"),
        )).alias("timestamp"),
        F.lit("INFO").alias("severity"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 6 > 0, F.lit("rare")).alias("cluster_name"),
        F.lit("t").alias("text_payload"), F.lit(None).cast("string").alias("message"),
    ).repartition(5)
    rows = sorted((r.timestamp is not None, r.timestamp or start, r.event_id, r.cluster_name) for r in entries.collect())
    for limit in (1, 30, 5000):
        whole = logs.log_lines(entries, entry_id="event_id", limit=limit).collect()
        assert sorted((r.line_no, r.event_id) for r in whole) == [(k + 1, r[2]) for k, r in enumerate(rows[:limit])]
        per = logs.log_lines(entries, entry_id="event_id", limit=limit, per="cluster_name").collect()
        want = []
        for name in ("hot", "rare", None):
            own = [r[2] for r in rows if r[3] == name]
            want += [(name, k + 1, i) for k, i in enumerate(own[:limit])]
        assert {(r.cluster_name, r.line_no, r.event_id) for r in per} == set(want) and len(per) == len(want)
    assert logs.log_lines(entries.limit(0), entry_id="event_id", limit=3).count() == 0


def test_limited_lines_read_entries_up_to_their_time(spark, tmp_path):
    path = str(tmp_path / "entries")
    spark.range(1000).select(
        F.col("id").alias("event_id"),
        F.timestamp_add("HOUR", F.col("id"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("timestamp"),
        F.lit("INFO").alias("severity"), F.lit("t").alias("text_payload"), F.lit("m").alias("message"),
    ).write.parquet(path)
    text = logs.log_lines(spark.read.parquet(path), entry_id="event_id", limit=5)._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [Or(IsNull(timestamp),LessThanOrEqual(timestamp,2024-01-01T04:" in text.toString()


def test_point_value_order(spark):
    df = spark.createDataFrame(
        [(1.5, 2, 3), (None, 2, 3), (None, None, 3), (None, None, 0), (None, None, None), (0.0, 2, 3)],
        "double_value double, int64_value long, distribution_count long",
    )
    assert [r[0] for r in df.select(series.point_value()).collect()] == [1.5, 2.0, 3.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("n", [600, 33_000])
def test_hot_series_is_numbered_whole(spark, n):
    start = datetime(2024, 1, 1)
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).alias("s"),
        F.timestamp_add("SECOND", (F.col("id") % 50).cast("int"), F.lit(start).cast("timestamp_ntz")).alias("end_time"),
        F.col("id").cast("double").alias("double_value"),
        F.lit(None).cast("bigint").alias("int64_value"),
        F.lit(None).cast("bigint").alias("distribution_count"),
    )
    got = series.metric_series(rows, "s").collect()
    for name in ("hot", None):
        mine = sorted((r["place"], r["timestamp"], r["value"]) for r in got if r["s"] == name)
        want = sorted((start + timedelta(seconds=i % 50), float(i)) for i in range(n) if (i % 3 != 0) == (name == "hot"))
        assert mine == [(k + 1, *x) for k, x in enumerate(want)]


def test_hot_keys_are_parted_without_adaptive_execution(spark):
    """One key has a third of all rows, a missing key another sixth."""
    left = spark.range(12_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 6 != 1, F.concat(F.lit("k"), F.col("id") % 900)).alias("k"),
    )
    right = pin(spark.range(900).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("x")).unionByName(
        spark.createDataFrame([("hot", 5000)], "k string, x long")
    ))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = lookup_join(left, right, "k", broadcast_rows=10)
        assert got.columns == left.join(right, "k", "left").columns
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text
        tasks = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert len(tasks) == 16 and tasks[-1] <= 2 * tasks[8]
        rows = sorted((r.id, r.k, r.x) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def key(i):
        return "hot" if i % 3 == 0 else None if i % 6 == 1 else f"k{i % 900}"

    assert rows == [(i, key(i), 5000 if i % 3 == 0 else None if i % 6 == 1 else i % 900) for i in range(12_000)]


def test_equal_points_are_numbered_in_several_tasks(spark):
    rows = spark.range(200_000).select(
        F.lit("hot").alias("s"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("end_time"),
        F.lit(1.0).alias("double_value"),
        F.lit(None).cast("bigint").alias("int64_value"),
        F.lit(None).cast("bigint").alias("distribution_count"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = series.metric_series(rows, "s").withColumn("task", F.spark_partition_id())
        assert got.columns == ["s", "timestamp", "value", "place", "task"]
        tasks = [r["count"] for r in got.groupBy("task").count().collect()]
        assert len(tasks) > 1 and max(tasks) < 150_000
        top = got.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()
        assert tuple(top) == (200_000, 1, 200_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("part_bytes", [1, 2, 3, 7, 64])
def test_parts_end_between_characters(spark, tmp_path, part_bytes):
    text = "aé日本\U0001f600 ñ\n\U0001f680\U0001f680z" * 5
    torn = b"\xe6\x97" + "日".encode() + b"\x80\x80\x80\x80\x80x"
    (tmp_path / "application_1_log").write_bytes(text.encode())
    (tmp_path / "application_2_log").write_bytes(torn)
    ids = spark.createDataFrame([("application_1",), ("application_2",)], "id string")
    got = event_logs.read_event_logs(spark, str(tmp_path), ids, part_bytes=part_bytes).orderBy("file_part").collect()
    joined = {i: "".join(r.content_snippet for r in got if r.application_id == i) for i in ("application_1", "application_2")}
    assert joined["application_1"] == text
    assert "日" in joined["application_2"] and joined["application_2"].endswith("x")


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_lookup_join_gives_the_same_rows_either_way(spark, broadcast_rows):
    """Broadcast and shuffle agree; one key has a third of all rows."""
    left = spark.range(300).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    ).unionByName(spark.createDataFrame([(1000, None)], "id long, k string"))
    right = pin(spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, v int"))
    got = lookup_join(left, right, "k", broadcast_rows=broadcast_rows)
    assert got.count() == 301
    assert got.where("k = 'hot' and v = 1").count() == 100
    assert got.where("v is null").count() == 301 - 100 - left.where("k in ('k1', 'k2')").count()


def test_results_do_not_depend_on_join_or_block_choice(spark):
    """The whole analysis with tiny limits, so that every fallback is taken."""
    from dataclasses import replace

    sf = "/root/testdata/sf0.001"
    ingested = monitor.ingest(load(spark, sf, "run_state"), FIXTURE_PARAMS, FIXTURE_AS_OF, uid="run_no")
    facts = load(spark, sf, "daily_facts")

    def result(params):
        found = monitor.analyse(ingested.runs, facts, params, FIXTURE_AS_OF, uid="run_no").found
        rows = found.select("uid", "baseline_source", "baseline.run_count", "has_issues", F.to_json("findings").alias("f"))
        return sorted(map(tuple, rows.collect()))

    assert result(FIXTURE_PARAMS) == result(replace(FIXTURE_PARAMS, broadcast_rows=1, block_rows=2))


def test_run_once_over_catalog_tables(spark, tmp_path):
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in FACT_SCHEMA.fields if f.name != "ingest_date"
    )
    spark.sql("CREATE DATABASE IF NOT EXISTS mon")
    spark.sql(
        f"CREATE TABLE mon.facts ({columns}, ingest_date date) USING parquet"
        f" PARTITIONED BY (ingest_date) LOCATION '{tmp_path}/facts'"
    )
    try:
        runs(spark, *(run(i) for i in range(3))).write.option("path", f"{tmp_path}/runs").saveAsTable("mon.runs")
        params = Params("p", "r1", bq_dataset="mon", bq_table="facts", run_state_table="runs")
        memory, lines = monitor.run_once(spark, params, AS_OF, uid="run_no", report_to=f"{tmp_path}/report")
        assert memory.summary["persisted_rows"] == 3 and spark.table("mon.facts").count() == 3
        assert spark.table("mon.facts").where("ingest_date = '2024-01-02' and job_id = 'etl_daily'").count() == 3
        lines = list(lines)
        assert [r[0] for r in spark.read.text(f"{tmp_path}/report").collect()] == lines
        assert lines[-3].startswith("- etl_daily (SPARK) state=SUCCEEDED duration=3600.0s")
        history.check_fact_table(spark, "mon.facts")
    finally:
        spark.sql("DROP DATABASE mon CASCADE")


def test_write_report(spark, tmp_path):
    from runlens.checks import queries as Q
    from runlens.operators import report as R

    out = Q._outcomes(spark, "/root/testdata/sf0.001")
    R.write_report(out, str(tmp_path / "report"))
    parts = sorted(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-"))
    written = [line for p in parts for line in p.read_text().splitlines()]
    assert written == list(R.iter_lines(out))


def test_snapshots_in_another_session_zone(spark):
    """TIMESTAMP input, with the hour that New York has twice."""
    from runlens.functions import clock
    from runlens.sources import snapshots

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        moments = ["2024-11-03 05:30:00Z", "2024-11-03 06:30:00Z", "2024-07-01 23:00:00Z"]
        df = spark.createDataFrame([(m,) for m in moments], "m string").select(
            "m", F.to_timestamp("m").alias("t"),
            F.struct(F.to_timestamp("m").alias("state_start_time")).alias("status"),
            F.array(F.struct(F.to_timestamp("m").alias("state_start_time"))).alias("status_history"),
        )
        iso = df.select(clock.iso_utc(clock.utc(df, "t")), clock.iso_utc(clock.utc(df, "m")))
        want = [m.replace(" ", "T").replace("Z", "+00:00") for m in moments]
        assert [tuple(r) for r in iso.collect()] == [(w, w) for w in want]
        inside = snapshots.jobs_in_window(df, datetime(2024, 7, 1, 22), datetime(2024, 7, 1, 23, 30))
        assert [r["m"] for r in inside.collect()] == [moments[2]]
        assert snapshots.jobs_in_window(df, datetime(2024, 7, 2), datetime(2024, 7, 3)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_documents_are_not_lost(spark):
    """Leading white space, a key twice, NaN, JSON null, and text that is no JSON."""
    import json

    texts = {
        1: '\n\t{"app": {"app_vcore_seconds": 5}, "jobs": []}',
        2: '{"app": {"app_vcore_seconds": 1}, "app": {"app_vcore_seconds": 5}}',
        3: '{"app": {"app_vcore_seconds": 5, "x": NaN, "y": [-Infinity]}}',
        4: "null",
        5: "{bad",
        6: "  ",
    }
    table = runs(spark, *(run(i, spark_event_metrics=t, cluster_config_details=t) for i, t in texts.items()))
    params = Params("p", "r1")
    memory = monitor.build_memory(
        monitor.ingest(table, params, AS_OF, uid="run_no"), empty_facts(spark), params, AS_OF, uid="run_no"
    )
    assert memory.summary["unreadable_runs"] == 1
    stored = {r["job_start_time"].minute: r for r in memory.facts.collect()}
    read = {i: json.loads(stored[i]["job_metrics"]) for i in texts}
    for i in (1, 2, 3):
        assert read[i]["app"]["app_vcore_seconds"] == 5 and "value" not in read[i]
        cluster = json.loads(stored[i]["cluster_metrics"])["cluster_config_details"]
        assert cluster["app"]["app_vcore_seconds"] == 5
    assert read[5]["unparsed"] == "{bad" and set(read[4]) == set(read[6]) == {"metadata"}
    assert json.loads(stored[5]["cluster_metrics"])["cluster_config_details"] == {"unparsed": "{bad"}
    flags = json.loads(stored[1]["anomaly_flags"])
    assert flags["baseline_reference"] == {} and flags["cost_summary"] == {"app_vcore_seconds": 5}


def test_report_of_stored_facts_with_gaps(spark):
    import json

    def fact(no, flags):
        row = dict.fromkeys(FACT_SCHEMA.names)
        moment = datetime(2024, 1, 1, no)
        row.update(
            ingest_date=moment.date(), ingest_timestamp=moment, job_id=f"j{no}", job_state="OK", cluster_name="c",
            job_start_time=moment, duration_seconds=2.0, driver_log_excerpt=f"logs/{no}",
            anomaly_flags=None if flags is None else json.dumps(flags),
        )
        return tuple(row[n] for n in FACT_SCHEMA.names)

    def report(*flags):
        facts = spark.createDataFrame([fact(i, f) for i, f in enumerate(flags)], FACT_SCHEMA)
        return list(R.iter_lines(monitor.stored_outcomes(facts, datetime(2024, 1, 1), datetime(2024, 1, 2))))

    from runlens.operators import report as R

    finding = {"message": "m", "severity": "warning"}
    lines = report(
        {"has_issues": True, "findings": [{"message": "none"}, finding], "recommendations": ["do this"]}, None
    )
    assert "- j0 (latest run j0) on cluster c: m" in lines and "- j0: do this" in lines
    assert not any("Monitor upcoming" in x for x in lines)
    lines = report({"has_issues": True, "findings": [finding], "job_family": "f", "run_identifier": "r"})
    assert "- f (latest run r) on cluster c: m" in lines
    assert lines[lines.index("Suggested actions:") + 1] == X.REPORT_NO_ACTION
    assert report(None)[4] == X.REPORT_CLEAN
