"""The fact table: history scan, newest rows, schema check, append."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.fixed import RECENT_FACTS
from runlens.functions import clock
from runlens.functions import metrics as M
from runlens.functions import variant as V
from runlens.schema import FACT_SCHEMA


def _path_number(v, path):
    """A scalar at the path as double, by way of text: booleans, objects and other
    non-numbers become NULL."""
    x = V.text(v, path).try_cast("double")
    return F.when(~F.isnan(x), x)


def scan_history(facts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Facts ingested in the closed window that have a duration, with four readings
    from the metric JSON. The extra date predicate follows from the timestamp one and
    prunes the ``ingest_date`` partitions."""
    V.accept_repeated_keys(facts.sparkSession)
    low, high = (clock.literal_for(facts, "ingest_timestamp", m) for m in (start, end))
    days = F.col("ingest_date").between(
        clock.date_literal(start.date()), clock.date_literal(end.date())
    )
    window = facts.where(
        days & F.col("ingest_timestamp").between(low, high) & F.col("duration_seconds").isNotNull()
    )
    v = F.col("doc")
    names = ("job_id", "job_type", "cluster_name", "duration_seconds")
    whole = window.select(*names, "job_metrics", V.parse(F.col("job_metrics")).alias("whole"))
    part = V.sections(F.col("job_metrics"), F.col("whole"), M.METRIC_SECTIONS)
    return whole.select(*names, F.coalesce("whole", part).alias("doc")).select(
        "job_id",
        "job_type",
        "cluster_name",
        "duration_seconds",
        _path_number(v, "$.app.app_vcore_seconds").alias("app_vcore_seconds"),
        _path_number(v, "$.app.app_memory_gb_seconds").alias("app_memory_gb_seconds"),
        _path_number(v, "$.jobs[0].max_over_median_ratio").alias("max_over_median_ratio"),
        _path_number(v, "$.jobs[0].p95_task_duration_ms").alias("p95_task_duration_ms"),
    )


def recent_facts(
    facts: DataFrame, limit: int = RECENT_FACTS, tiebreak: tuple[str, ...] = ("job_id",)
) -> DataFrame:
    """The newest facts. Planned as a per-task top-k and one merge of ``limit`` rows."""
    return facts.orderBy(F.desc("ingest_timestamp"), *tiebreak).limit(limit)


def decode_facts(facts: DataFrame) -> DataFrame:
    """The three JSON columns as VARIANT; NULL and malformed text read as ``{}``. Metrics too
    large for the parser have the sections that the library reads."""
    V.accept_repeated_keys(facts.sparkSession)
    empty = F.parse_json(F.lit("{}"))
    wanted = {"cluster_metrics": M.STORED_CLUSTER_SECTIONS, "job_metrics": M.METRIC_SECTIONS}

    def decoded(c: str) -> Column:
        v = V.parse(F.col(c))
        return F.coalesce(v, V.sections(F.col(c), v, wanted[c]), empty) if c in wanted else F.coalesce(v, empty)

    return facts.withColumns({c: decoded(c) for c in (*wanted, "anomaly_flags")})


def check_fact_table(spark: SparkSession, table: str) -> None:
    """The fact table must exist with the declared columns; it is never created."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACT_SCHEMA.fields)
        raise RuntimeError(f"no fact table {table}; a table with these columns is needed: {columns}")
    check_fact_schema(spark.table(table), table)


def check_fact_schema(facts: DataFrame, name: str = "facts") -> None:
    found = {f.name: f.dataType for f in facts.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        f"{found[f.name].simpleString() if f.name in found else 'nothing'}"
        for f in FACT_SCHEMA.fields
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise RuntimeError(f"Fact table '{name}' does not fit: {'; '.join(wrong)}")


def append_facts(
    facts: DataFrame, target: str, *, dry_run: bool = False, as_path: bool = False
) -> DataFrame:
    """Append the 18 fact columns, partitioned by ingest date. Nothing is removed or
    deduplicated, so a second run adds the rows again. A dry run writes nothing."""
    rows = facts.select(*FACT_SCHEMA.names)
    check_fact_schema(rows)
    if dry_run:
        return rows
    if as_path:
        rows.write.mode("append").partitionBy("ingest_date").parquet(target)
    else:
        # By position, into the table's own column order and partitioning.
        spark = rows.sparkSession
        rows.select(*spark.table(target).columns).write.insertInto(target)
    return rows


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts from a path, read with the declared schema: no inference job."""
    return spark.read.schema(FACT_SCHEMA).parquet(path).select(*FACT_SCHEMA.names)
