"""The sweep against a plain sequential model and against the window form."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.functions.clock import ORDER
from runlens.operators.profile import MEASURES, has_measure
from runlens.operators.ranking import exact_quantiles, line_numbers
from runlens.operators.running import running_baselines
from runlens.operators.sweep import AVERAGES, SLICES
from runlens.schema import BASELINE_SCHEMA
from runlens.storage import pin

SCHEMA = (
    "job_id string, o1 timestamp_ntz, o1_timed int, o2 timestamp_ntz, o2_timed int, run_identifier string,"
    " uid string, cluster_name string, " + ", ".join(f"{m} double" for m in MEASURES)
)


def make(seed, sizes, ties=False):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    rows = []
    for family, size in sizes.items():
        drift = rng.choice([0, 1, -1])
        for i in range(size):
            t = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(3 if ties else 10_000))
            missing = rng.random() < 0.1
            values = []
            for _ in MEASURES:
                x = rng.choice([0.0, 1.0, 2.0]) if ties else rng.uniform(0, 100) + drift * i
                values.append(None if missing or rng.random() < 0.15 else x)
            timed = int(rng.random() > 0.05)
            rows.append(
                (family, t, timed, t, timed, f"r{rng.randrange(5)}", f"{family}-{i:05}", f"c{rng.randrange(4)}", *values)
            )
    rng.shuffle(rows)
    return rows


def quantile(values, rank):
    if not values:
        return None
    values = sorted(values)
    at = (len(values) - 1) * rank
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def model(rows):
    """Runs one after another, with a list of samples per family."""
    seen, out = {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[1:7])):
        family, uid, cluster, values = row[0], row[6], row[7], row[8:]
        samples = seen.setdefault(family, [])
        if family and samples:
            columns = [[s[i] for s, _ in samples if s[i] is not None] for i in range(len(MEASURES))]
            out[uid] = {
                "p50_duration": quantile(columns[0], 0.5),
                "p95_duration": quantile(columns[0], 0.95),
                "p50_app_vcore_seconds": quantile(columns[1], 0.5),
                "p95_app_memory_gb_seconds": quantile(columns[2], 0.95),
                "avg_max_over_median_ratio": sum(columns[3]) / len(columns[3]) if columns[3] else None,
                "p95_task_duration_ms": quantile(columns[4], 0.95),
                "run_count": len(samples),
                "cluster_name": samples[-1][1],
            }
        if any(v is not None for v in values):
            samples.append((values, cluster))
    return out


def check(got, want):
    got = {r["uid"]: r for r in got.collect()}
    assert got.keys() == want.keys()
    for uid, stats in want.items():
        for name, value in stats.items():
            if isinstance(value, float):
                assert got[uid][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (uid, name)
            else:
                assert got[uid][name] == value, (uid, name)


def windowed_baselines(samples):
    """The plain window form, a second model of the sweep."""
    w = Window.partitionBy("job_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    counted = has_measure()
    stats = {"cluster_name": F.last(F.when(counted, F.col("cluster_name")), ignorenulls=True).over(w)}
    stats["run_count"] = F.count(F.when(counted, F.lit(1))).over(w)
    stats |= {name: F.percentile(m, rank).over(w) for name, m, rank in SLICES}
    stats |= {name: F.avg(m).over(w) for name, m in AVERAGES}
    rows = samples.where(F.col("job_id") != "").select(
        "uid", "job_id", F.lit("SPARK").alias("job_type"),
        *(c.alias(name) for name, c in stats.items()),
    )
    return rows.where(F.col("run_count") > 0).select("uid", *BASELINE_SCHEMA.names)


# One family holds most rows; block sizes make it span many blocks and partitions.
@pytest.mark.parametrize("block_rows", [3, 16, 50, 65_536])
@pytest.mark.parametrize("ties", [False, True])
def test_sweep_equals_sequential_model(spark, block_rows, ties):
    rows = make(block_rows, {"hot": 400, "mid": 60, "a": 5, "b": 1, "": 7}, ties)
    samples = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(running_baselines(samples, block_rows=block_rows), model(rows))


def test_window_form_equals_sequential_model(spark):
    rows = make(7, {"hot": 150, "a": 5, "": 3})
    check(windowed_baselines(spark.createDataFrame(rows, SCHEMA)), model(rows))


def test_hot_family_is_cut_into_blocks(spark):
    """No block holds more rows than asked, and what it is told of earlier blocks is
    bounded by the block size, not by the family size."""
    from runlens.operators.running import block_stream
    rows = make(1, {"hot": 3000, "a": 4})
    stream = block_stream(spark.createDataFrame(rows, SCHEMA), block_rows=100)
    per_block = stream.groupBy("job_id", "block").agg(
        F.sum((F.col("kind") == 2).cast("int")).alias("runs"),
        F.sum(F.coalesce(F.size("numbers"), F.lit(0))).alias("numbers"),
    )
    top = per_block.agg(F.max("runs"), F.max("numbers"), F.count("*")).first()
    assert top[0] == 100 and top[2] == 31
    assert top[1] <= len(SLICES) * 6 * 100


def test_blocks_are_told_of_no_bucket_without_earlier_values(spark):
    """Early blocks ask for buckets all over the family, most of which hold later values only."""
    from runlens.operators.running import block_stream

    rows = make(2, {"hot": 2000})
    told = block_stream(spark.createDataFrame(rows, SCHEMA), block_rows=16).where("kind = 1")
    assert told.count() > 0 and told.where(F.size("numbers") <= 2).count() == 0


@pytest.mark.parametrize("drift", [0, 1])
def test_counts_grow_with_the_blocks(spark, monkeypatch, drift):
    """What blocks are told of bucket counts: a fixed number of rows per block and level of the
    tree, not one per block and bucket."""
    from runlens.operators import running

    asked = {}
    for blocks in (16, 64, 256):
        rows = spark.range(blocks * 8).select(
            F.lit("hot").alias("job_id"),
            F.col("id").alias("row_id"),
            F.floor(F.col("id") / 8).cast("int").alias("block"),
            *((F.hash("id", F.lit(m)) % 1000 + drift * F.col("id")).cast("double").alias(m) for m in MEASURES),
        )
        counts = []

        def counted(df, counts=counts):
            out = pin(df)
            if "rank" in out.columns:
                counts.append(out.count())
            return out

        monkeypatch.setattr(running, "pin", counted)
        running._values_in_reach(rows, 8).count()
        assert len(counts) == {16: 1, 64: 2, 256: 2}[blocks]
        assert max(counts) <= 2 * len(SLICES) * blocks
        asked[blocks] = sum(counts)
    assert asked[64] <= 2 * 4 * asked[16] * 1.1 and asked[256] <= 4 * asked[64] * 1.1


def test_small_families_move_once(spark):
    samples = pin(spark.createDataFrame(make(1, {"a": 40, "b": 30}), SCHEMA))
    text = running_baselines(samples, block_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "hashpartitioning(job_id" in text and "Scan ExistingRDD" in text


@pytest.mark.parametrize("hot_value", [None, 5.0])
def test_exact_quantiles(spark, hot_value):
    rng = random.Random(3)
    rows = [("hot", hot_value if hot_value and rng.random() < 0.5 else rng.uniform(0, 9)) for _ in range(501)]
    rows += [("one", 4.0), ("none", None)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k]["p50"] == pytest.approx(quantile(values, 0.5))
        assert got[k]["p95"] == pytest.approx(quantile(values, 0.95))


def test_line_numbers(spark):
    df = spark.range(0, 500).select((500 - F.col("id")).alias("x")).repartition(7)
    rows = line_numbers(df, ["x"]).collect()
    assert all(r["line_no"] == r["x"] for r in rows) and len(rows) == 500


def test_pin_uses_the_session_folder(spark):
    pinned = pin(spark.range(10))
    assert pinned.count() == 10
    assert spark.sparkContext.getCheckpointDir().startswith(
        "file:" + spark.conf.get("spark.checkpoint.dir").rstrip("/")
    ) or spark.conf.get("spark.checkpoint.dir").rstrip("/") in spark.sparkContext.getCheckpointDir()


def test_tasks_need_no_copy_of_the_package():
    """The sweep travels by value: it loads where this package cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from runlens.operators.sweep import sweep

    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); assert list(f(iter([]))) == []"
    sent = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(sweep), cwd="/", capture_output=True)
    assert sent.returncode == 0, sent.stderr
