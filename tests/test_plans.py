"""The physical plans are the intended ones."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runlens.checks import queries as Q
from runlens.fixtures import AS_OF, PARAMS, BASE_TABLES, _derive, duck_with, load
from runlens.operators import report as R
from runlens.operators.baseline import historical_baseline
from runlens.operators.facts import fact_rows
from runlens.plans.monitor import analyse, ingest
from runlens.schema import FACT_SCHEMA
from runlens.sources import history, logs, run_state

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_predicate_reaches_the_scan(spark):
    text = plan(run_state.scan_runs(load(spark, SF, "run_state"), Q.START, Q.END))
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(application_start_time" in text
    assert "Exchange" not in text


def test_order_lines_move_as_numbers_and_give_the_same_text(spark, tmp_path):
    import duckdb

    for table in BASE_TABLES:
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        if table == "lineitem":
            some = rows.where("l_orderkey % 5 = 0")
            odd = some.withColumn("l_quantity", F.expr("CASE WHEN l_orderkey % 2 = 0 THEN l_quantity + 9 END"))
            lost = some.withColumn("l_orderkey", F.lit(None).cast("bigint"))
            rows = rows.union(some).union(odd).union(lost)
        rows.write.parquet(str(tmp_path / f"{table}.parquet"))
    derived = _derive(spark, str(tmp_path), "run_state")
    text = plan(derived)
    assert '"job_id":' in text and '"job_id":' not in text[text.index("Exchange") :]
    db = duckdb.connect()
    for table in BASE_TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    columns = "run_no, spark_event_metrics, cluster_config_details, dataproc_jobid"
    wanted = db.sql(f"{duck_with('run_state')} SELECT {columns} FROM run_state").fetchall()
    got = [tuple(r) for r in derived.select(*columns.split(", ")).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_history_prunes_partitions_and_columns(spark, tmp_path):
    path = str(tmp_path / "facts")
    load(spark, SF, "daily_facts").where("ingest_date >= '1999-12-20'").write.partitionBy("ingest_date").parquet(path)
    facts = history.read_facts(spark, path)
    assert facts.schema == FACT_SCHEMA
    scanned = history.scan_history(facts, datetime(1999, 12, 28), datetime(2000, 1, 1))
    text = plan(scanned)
    assert "PartitionFilters: [isnotnull(ingest_date" in text
    assert "cluster_metrics" not in text and "anomaly_flags" not in text
    # Once as it is, and once mended, which only runs for text with NaN or Infinity in it.
    assert text.count("parseJson") == 2


def test_history_aggregates_before_its_one_shuffle(spark):
    scanned = history.scan_history(load(spark, SF, "daily_facts"), Q.HISTORY_START, Q.HISTORY_END)
    text = plan(historical_baseline(scanned))
    assert text.count("Exchange") == 1 and "partial_percentile_approx" in text


def test_top_k_is_not_a_full_sort(spark):
    facts = load(spark, SF, "daily_facts")
    assert "TakeOrderedAndProject" in plan(history.recent_facts(facts))
    assert "TakeOrderedAndProject" in plan(R.highlights(Q._outcomes(spark, SF)))


def test_facts_move_no_wide_row(spark):
    """Small lookups: the documents go from scan to sink without a shuffle, parsed once."""
    facts = Q._facts(spark, SF)
    text = plan(facts)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning" not in text
    assert text.count("parseJson(spark_event_metrics") == 1
    assert "Python" not in text and "InArrow" not in text


def test_report_reduces_before_shuffling(spark):
    text = plan(R.worst_findings(Q._outcomes(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min" in text


def test_report_is_made_of_one_aggregate(spark, tmp_path):
    """One scan and one exchange for states, families and suggestions; the highlights take the
    first few of a second scan; no list of all states is gathered."""
    path = str(tmp_path / "outcomes")
    Q._outcomes(spark, SF).write.parquet(path)
    outcomes = spark.read.parquet(path)
    entries = plan(R.report_entries(outcomes))
    assert entries.count("FileScan parquet") == 1 and entries.count("Exchange") == 1 and "partial_min" in entries
    lines = plan(R.report_lines(outcomes))
    assert lines.count("FileScan parquet") == 1 and "TakeOrderedAndProject" in lines and "collect_list" not in lines


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - {"running_baseline", "running_baseline_blocks", "fact_roundtrip", "stored_report"}))
def test_no_python_in_other_plans(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    assert "EvalPython" not in text and "InPandas" not in text and "InArrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_log_texts_stay_where_they_are(spark):
    """The cut-off is found on narrow rows; texts meet only the chosen lines, broadcast."""
    entries = load(spark, SF, "log_entries")
    text = plan(logs.log_lines(entries, entry_id="event_id", per="cluster_name", limit=2000))
    assert not [x for x in text.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert "BroadcastHashJoin" in text


def test_large_lookups_do_not_repeat_the_runs(spark):
    """One scan and one parse of the metric documents, with both lookups shuffled."""
    from dataclasses import replace

    tight = replace(PARAMS, broadcast_rows=1)
    ingested = ingest(load(spark, SF, "run_state"), tight, AS_OF, uid="run_no")
    wide = analyse(ingested.runs, load(spark, SF, "daily_facts"), tight, AS_OF, uid="run_no").wide
    text = plan(fact_rows(wide, tight, AS_OF))
    assert text.count("FileScan parquet") == 1 and "SortMergeJoin" in text


def test_whole_tables(spark):
    """Field queries keep every run."""
    n = load(spark, SF, "run_state").count()
    for name in ("normalize_id", "job_family", "run_duration", "cost_summary", "baseline_join"):
        assert Q.QUERIES[name](spark, SF).agg(F.count("*")).first()[0] == n
