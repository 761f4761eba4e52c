"""Input tables derived from the test data, one SQL text for Spark and DuckDB."""

from __future__ import annotations

import hashlib
import os
from datetime import datetime
from string import Template

from pyspark.sql import DataFrame, SparkSession

from runlens.fixtures.texts import JOB, STAGE, TEXTS
from runlens.params import Params
from runlens.sources.history import read_facts
from runlens.storage import shared_folder

AS_OF = datetime(2000, 6, 29)
# Look-back 180 days to 2000-01-01; the history reaches 365 days further back.
PARAMS = Params(
    project_id="demo-project", region="r1", lookback_hours=180 * 24, baseline_days=545, dry_run=True
)
BASE_TABLES = ("orders", "lineitem", "customer", "events", "documents", "nation")


def _joined(line_json: str) -> str:
    """The JSON of an order's lines, which came together as numbers, in their order."""
    told = f"transform(l.held, x -> struct(x.l_linenumber, x.l_partkey, x.l_suppkey, {line_json} AS line))"
    return f"array_join(transform(sort_array(filter({told}, y -> y.line IS NOT NULL)), y -> y.line), ',')"


# The lines of an order travel as numbers and become text in the task that writes them.
_SPARK = {
    "order_lines": """SELECT l_orderkey, collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_quantity)) AS held
 FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
   FROM $lineitem WHERE l_orderkey IS NOT NULL) t GROUP BY l_orderkey""",
    "jobs": _joined(Template(JOB).substitute(line="x.")),
    "stages": _joined(Template(STAGE).substitute(line="x.")),
    "orders_with_lines": "o LEFT JOIN $customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey",
    "run_seconds": "timestampdiff(MICROSECOND, application_start_time, application_end_time) / 1e6D",
    "app_ids": "CASE WHEN application_id IS NULL OR application_id = '' THEN array()"
    " ELSE array(application_id) END",
}
_DUCK = {
    "order_lines": f"""SELECT l_orderkey,
  string_agg(j, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, j) AS jobs, string_agg(s, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, s) AS stages
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
   {Template(JOB).substitute(line="")} AS j,
   {Template(STAGE).substitute(line="")} AS s
   FROM $lineitem) t GROUP BY l_orderkey""",
    "jobs": "l.jobs",
    "stages": "l.stages",
    "orders_with_lines": "o LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN $customer ON c_custkey = o_custkey",
    "run_seconds": "(epoch_us(application_end_time) - epoch_us(application_start_time)) / 1e6",
    "app_ids": "CASE WHEN application_id IS NULL OR application_id = '' THEN []"
    " ELSE [application_id] END",
}
_NEEDS = {"daily_facts": ("run_state",)}

_written: dict[tuple[str, str, str], str] = {}


def _filled(name: str, engine: dict[str, str], tables: dict[str, str]) -> str:
    # The engine's parts name tables too.
    return Template(Template(TEXTS[name]).safe_substitute(engine)).substitute(tables)


def duck_with(*names: str) -> str:
    """CTE text of fixtures for a DuckDB query, each after what it needs."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, ()), name) if n not in order]
    tables = {t: t for t in BASE_TABLES} | {"run_state": "run_state"}
    return "WITH " + ",\n".join(
        f"{n} AS ({_filled(n, _DUCK, tables)})" for n in order
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a parquet table in the shared folder, derived on first use.

    Reading it back from files gives the operators a real scan to push into.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _written:
        tag = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        path = f"{shared_folder(spark).rstrip('/')}/runlens-{name}-{tag}"
        derived = _derive(spark, sf_dir, name)
        if name == "daily_facts":
            # Clustered by date, so that a date predicate skips files and row groups. A real
            # fact table is partitioned by date, but days of this data are a few rows each.
            derived = derived.repartitionByRange("ingest_date").sortWithinPartitions("ingest_date")
        derived.write.mode("overwrite").parquet(path)
        _written[key] = path
    if name == "daily_facts":
        return read_facts(spark, _written[key])
    return spark.read.parquet(_written[key])


def _derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views = {t: f"runlens_{t}" for t in (*BASE_TABLES, "run_state")}
    for table in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(views[table])
    for needed in _NEEDS.get(name, ()):
        load(spark, sf_dir, needed).createOrReplaceTempView(views[needed])
    return spark.sql(_filled(name, _SPARK, views))
