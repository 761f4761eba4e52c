"""Documents too large for the parser: their sections are read by streaming."""

import json
import subprocess
import sys
import textwrap
from datetime import datetime

from conftest import ROOT
from frames import run
from pyspark.sql import functions as F

from runlens.functions import metrics as M
from runlens.functions import variant as V

AS_OF = datetime(2024, 1, 2)

DOCS = [
    '{"app": {"app_vcore_seconds": 5, "x": [1, {"y": 2}]}, "jobs": [{"job_id": 0, "max_over_median_ratio": "3.5"}]}',
    '{"jobs": [7, null, "x", {"job_id": "0", "name": null, "max_over_median_ratio": 9}], "app": 5, "stages": "no"}',
    '{"stages": [{"stageId": 3, "numTasks": 7, "p95TaskDurationMs": 2.5, "more": {}}], "app": {"executor_peak": null}}',
    '{"app": {"app_vcore_seconds": 1}, "app": {"app_vcore_seconds": 5}, "x": NaN}',
    '{"metadata": {"job_family": "own", "z": [1]}, "jobs": {}, "other": "thing"}',
]
UNREADABLE = ["{bad", '{"app": {"app_vcore_seconds": 5}', "[1, 2]", "{'app': {'app_vcore_seconds': 5}}", '{"other": 1}', "", None]


def test_sections_give_the_readings_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(V, "LARGE", -1)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS + UNREADABLE)], "i int, t string")
    none = F.try_parse_json(F.nullif(F.col("t"), F.col("t")))
    read = df.select("i", V.parse(F.col("t")).alias("whole"), V.sections(F.col("t"), none, M.METRIC_SECTIONS).alias("part"))

    def readings(name):
        v = F.col(name)
        jobs = V.objects(v, "$.jobs")
        return F.to_json(
            F.struct(
                M.cost_summary(v).alias("cost"), M.job_sample(M.first_job(jobs)).alias("sample"),
                M.job_details(M.worst_job(jobs, 3.0)).alias("job"), M.worst_stage(M.stage_rows(v)).alias("stage"),
                F.to_json(V.field(v, "$.metadata")).alias("metadata"),
            )
        )

    rows = read.select("part", readings("whole").alias("a"), readings("part").alias("b")).orderBy("i").collect()
    for text, r in zip(DOCS, rows, strict=False):
        assert r.part is not None and r.a == r.b, text
    assert [r.part for r in rows[len(DOCS) :]] == [None] * len(UNREADABLE)
    # A document that was parsed whole, or is small, is not streamed.
    assert df.where(V.sections(F.col("t"), F.parse_json(F.lit("1")), M.METRIC_SECTIONS).isNotNull()).count() == 0
    monkeypatch.setattr(V, "LARGE", 1 << 20)
    assert df.where(V.sections(F.col("t"), none, M.METRIC_SECTIONS).isNotNull()).count() == 0


def test_facts_keep_the_whole_text_of_a_large_document(spark, monkeypatch):
    """Texts of the parsed kind, all handled as large ones that the parser refused."""
    from test_semantics import PARAMS, found

    from runlens.operators.facts import fact_rows

    config = {"config": {"workerConfig": {"numInstances": 4, "machineTypeUri": "m"}, "autoscalingConfig": {"p": 1}}, "pad": 1}
    docs = [*DOCS[:3], DOCS[4]]
    rows = [run(i, spark_event_metrics=t, cluster_config_details=json.dumps(config)) for i, t in enumerate(docs)]
    small = fact_rows(found(spark, rows), PARAMS, AS_OF).orderBy("job_start_time").collect()
    monkeypatch.setattr(V, "LARGE", -1)
    monkeypatch.setattr(V, "parse", lambda text: F.try_parse_json(F.nullif(text, text)))
    large = fact_rows(found(spark, rows), PARAMS, AS_OF).orderBy("job_start_time").collect()
    for a, b in zip(small, large, strict=True):
        a, b = a.asDict(), b.asDict()
        if '"own"' in a["job_metrics"]:  # with a metadata section the text stays as it is
            assert b.pop("job_metrics") == docs[3] and a.pop("job_metrics")
        assert json.loads(a.pop("cluster_metrics")) == json.loads(b.pop("cluster_metrics"))
        assert a == b


def test_a_document_over_the_limit_gives_its_readings(tmp_path):
    """140 MB in one text value, in metrics and cluster document, from the runs to the history."""
    script = textwrap.dedent(
        """
        import sys
        from datetime import datetime
        sys.path[:0] = ROOTS
        from pyspark.sql import SparkSession, functions as F
        spark = (SparkSession.builder.master("local[1]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", sys.argv[1] + "/cp").getOrCreate())
        import pyarrow as pa, pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        from frames import NAMES, RUN_SCHEMA, run
        from runlens.params import Params
        from runlens.plans import monitor
        from runlens.schema import FACT_SCHEMA
        from runlens.sources.history import read_facts, scan_history
        pad = "0123456789" * 14_000_000
        metrics = '{"pad": "%s", "app": {"app_vcore_seconds": 5}, "jobs": [{"job_id": 1, "max_over_median_ratio": 9.5}]}' % pad
        cluster = '{"config": {"workerConfig": {"numInstances": 4}}, "pad": "%s"}' % pad
        rows = run(1, spark_event_metrics=metrics, cluster_config_details="{}"), run(2, cluster_config_details=cluster)
        schema = to_arrow_schema(spark.createDataFrame([], RUN_SCHEMA).schema)
        pq.write_table(pa.Table.from_pylist([dict(zip(NAMES, r)) for r in rows], schema), sys.argv[1] + "/runs.parquet")
        table = spark.read.parquet(sys.argv[1] + "/runs.parquet")
        as_of, params = datetime(2024, 1, 2), Params("p", "r1")
        memory = monitor.build_memory(monitor.ingest(table, params, as_of, uid="run_no"), spark.createDataFrame([], FACT_SCHEMA), params, as_of,
                                      uid="run_no", target=sys.argv[1] + "/facts", as_path=True)
        assert memory.summary["unreadable_runs"] == 0, memory.summary
        out = memory.outcomes.orderBy("uid").collect()
        assert out[0].vcore_text == "5.0" and [f.kind for f in out[0].findings] == ["task_straggler_detected"], out
        facts = read_facts(spark, sys.argv[1] + "/facts").orderBy("job_start_time")
        got = facts.select(F.length("job_metrics").alias("m"), F.length("cluster_metrics").alias("c"),
                           F.substring("job_metrics", -100, 100).alias("tail"), F.substring("cluster_metrics", -200, 200).alias("end")).collect()
        assert got[0].m > 140_000_000 and '"metadata":{"run_identifier"' in got[0].tail, got
        assert got[1].c > 140_000_000 and '"primary_workers":4' in got[1].end, got
        h = scan_history(facts, datetime(2024, 1, 1), as_of).where("app_vcore_seconds IS NOT NULL").collect()
        assert [(r.app_vcore_seconds, r.max_over_median_ratio) for r in h] == [(5.0, 9.5)], h
        print("read")
        """
    ).replace("ROOTS", repr([ROOT, f"{ROOT}/tests"]))
    done = subprocess.run([sys.executable, "-c", script, str(tmp_path)], capture_output=True, text=True, timeout=400)
    assert "read" in done.stdout, done.stdout + done.stderr[-3000:]
