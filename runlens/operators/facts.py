"""Fact rows: the 18 stored columns, and the narrow outcome rows the report reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import metrics as M
from runlens.functions import variant as V
from runlens.functions.clock import ORDER, order_columns
from runlens.functions.identity import non_empty
from runlens.functions.wording import fixed
from runlens.operators.detect import anomaly_flags
from runlens.params import Params, naive_utc
from runlens.schema import FACT_SCHEMA


def _without_nulls(v):
    """JSON null fields out: stored payloads drop absent cost entries."""
    return F.when(~F.is_variant_null(v), v)


def fact_rows(found: DataFrame, params: Params, as_of: datetime) -> DataFrame:
    """One fact per run, JSON columns as text, in the declared schema. ``found`` is a
    profiled run with baseline and findings."""
    stamp = naive_utc(as_of)
    cost = F.col("cost_summary")
    names = ("app_vcore_seconds", "app_memory_gb_seconds", "executor_peak")
    staged = found.withColumns(
        {
            "cost_summary": F.struct(*(_without_nulls(cost[n]).alias(n) for n in names)),
            "cluster_object": V.object_text(
                F.col("cluster_config_details"), F.col("cluster_doc"), F.col("cluster_part")
            ),
        }
    )
    app_id = non_empty(F.col("application_id"))
    # The profile always has fields, so the rest is never an empty object.
    rest = F.to_json(F.struct(F.col("dataproc_cluster_uuid"), F.col("cluster_profile")))
    cluster_metrics = F.concat(
        F.lit('{"cluster_config_details":'), F.col("cluster_object"), F.lit(","), F.substring(rest, 2, 2**31 - 1)
    )
    rows = {
        "ingest_date": F.lit(stamp.date().isoformat()),
        "ingest_timestamp": F.lit(stamp.isoformat(sep=" ")),
        "project_id": F.lit(params.project_id),
        "region": F.lit(params.region),
        "cluster_name": F.col("cluster_name"),
        "job_id": F.col("job_id"),
        "job_type": F.lit("SPARK"),
        "job_state": F.col("job_state"),
        "job_start_time": F.col("job_start_time"),
        "job_end_time": F.col("job_end_time"),
        "duration_seconds": F.col("duration_seconds"),
        "yarn_application_ids": F.array_compact(F.array(app_id)),
        "cluster_metrics": cluster_metrics,
        "job_metrics": M.enriched_metrics(
            F.col("spark_event_metrics"),
            F.col("metrics_doc"),
            F.col("metrics_part"),
            F.col("run_identifier"),
            F.col("job_id"),
        ),
        "driver_log_excerpt": F.col("log_location"),
        "yarn_log_excerpt": F.lit(None),
        "spark_event_snippet": M.event_snippet(F.col("app_doc"), F.col("first_job_doc")),
        "anomaly_flags": F.to_json(anomaly_flags()),
    }
    return staged.select(
        *(rows[f.name].cast(f.dataType).alias(f.name) for f in FACT_SCHEMA.fields)
    )


def _shown(raw):
    """A cost value as the report shows it: numbers to one decimal, text as it is."""
    number = V.field(raw, "$", "double")
    return F.when(~V.is_text(raw) & number.isNotNull(), fixed(number, 1)).otherwise(V.text(raw, "$"))


def outcomes(found: DataFrame) -> DataFrame:
    """What the report needs of each run, without the JSON documents."""

    def shown(name: str):
        return _shown(F.col("cost_summary")[name])

    b = F.col("baseline")
    return found.select(
        *ORDER,
        "job_id",
        "cluster_name",
        "job_state",
        "duration_seconds",
        "has_issues",
        "unreadable",
        F.transform(
            "findings",
            lambda f: F.struct(
                f["kind"].alias("kind"),
                f["severity"].alias("severity"),
                f["message"].alias("message"),
                f["action"].alias("action"),
            ),
        ).alias("findings"),
        F.transform("findings", lambda f: f["action"]).alias("recommendations"),
        b["p50_duration"].alias("baseline_median"),
        b["run_count"].alias("baseline_runs"),
        shown("app_vcore_seconds").alias("vcore_text"),
        shown("app_memory_gb_seconds").alias("memory_text"),
    )


def outcomes_of_facts(
    facts: DataFrame, *, uid: Column | None = None, run_date: Column | None = None
) -> DataFrame:
    """The rows of ``outcomes`` read back from stored facts, so that a report needs no run.

    ``uid`` tells facts of equal times apart (default: their log location); a fact without
    times is placed by ``run_date`` (default: its ingest date). A finding without a severity
    ranks last; one without an action takes the payload's first recommendation, if any.
    """
    a = F.col("flags")
    start, end = F.col("job_start_time"), F.col("job_end_time")
    day = F.col("ingest_date") if run_date is None else run_date
    key = F.col("driver_log_excerpt") if uid is None else uid
    read = facts.select(
        *order_columns(start, end, day),
        key.cast("string").alias("uid"),
        "job_id",
        "cluster_name",
        "job_state",
        "duration_seconds",
        "anomaly_flags",
        V.parse(F.col("anomaly_flags")).alias("flags"),
    )
    first = V.truthy_text(a, "$.recommendations[0]")
    findings = F.transform(
        V.objects(a, "$.findings"),
        lambda f: F.struct(
            V.text(f, "$.kind").alias("kind"),
            V.text(f, "$.severity").alias("severity"),
            F.coalesce(V.text(f, "$.message"), F.lit("")).alias("message"),
            F.coalesce(V.truthy_text(f, "$.action"), first).alias("action"),
        ),
    )
    family = V.truthy_text(a, "$.job_family")
    return read.select(
        *(c for c in ORDER if c not in ("run_identifier", "uid")),
        F.coalesce(V.truthy_text(a, "$.run_identifier"), F.col("job_id")).alias("run_identifier"),
        "uid",
        F.coalesce(family, F.col("job_id")).alias("job_id"),
        "cluster_name",
        "job_state",
        "duration_seconds",
        F.coalesce(V.field(a, "$.has_issues", "boolean"), F.lit(False)).alias("has_issues"),
        V.unreadable(F.col("anomaly_flags"), a).alias("unreadable"),
        findings.alias("findings"),
        F.transform(V.objects(a, "$.recommendations"), lambda r: V.text(r, "$")).alias("recommendations"),
        V.number(a, "$.baseline_reference.p50_duration").alias("baseline_median"),
        V.integer(a, "$.baseline_reference.run_count").alias("baseline_runs"),
        _shown(V.field(a, "$.cost_summary.app_vcore_seconds")).alias("vcore_text"),
        _shown(V.field(a, "$.cost_summary.app_memory_gb_seconds")).alias("memory_text"),
    )


def memory_summary(found: DataFrame, dry_run: bool = False) -> DataFrame:
    """Rows handled, dry-run flag, whether any run has an issue, and how many runs have a
    document that could not be read."""
    return found.agg(
        F.count("*").alias("persisted_rows"),
        F.lit(dry_run).alias("dry_run"),
        F.coalesce(F.bool_or("has_issues"), F.lit(False)).alias("has_anomalies"),
        F.count_if("unreadable").alias("unreadable_runs"),
    )
