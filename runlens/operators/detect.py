"""The four detectors and their synthesis, as expressions over a profiled run.

Each detector gives a ``FINDING`` struct or NULL. All divisions are ``try_divide``: with
ANSI on, a guard around a plain division does not keep it from being evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.fixed import (
    COST_ACTION,
    RUNTIME_ACTION,
    SATURATED_ACTION,
    STRAGGLER_ACTION,
    STRAGGLER_STAGE_ACTION,
    UNDERUSED_ACTION,
    COST_MESSAGE,
    RUNTIME_MESSAGE,
    SATURATED_MESSAGE,
    STRAGGLER_MESSAGE,
    STRAGGLER_STAGE,
    UNDERUSED_MESSAGE,
    WORKERS_MESSAGE,
)
from runlens.functions.wording import fill, fixed, shortest
from runlens.params import Thresholds
from runlens.schema import EVIDENCE, STAGE_EVIDENCE


def _struct(schema: T.StructType, values: dict[str, Column]) -> Column:
    """The values as a struct of the given type, NULL for fields without one."""
    nothing = F.lit(None)
    return F.struct(*(values.get(f.name, nothing).alias(f.name) for f in schema.fields)).cast(
        schema.simpleString()
    )


def _finding(kind: str | Column, severity: Column, message: Column, action: Column, **evidence):
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("kind"),
        severity.alias("severity"),
        message.alias("message"),
        _struct(EVIDENCE, evidence).alias("evidence"),
        action.alias("action"),
    )


def _severity(critical: Column) -> Column:
    return F.when(critical, F.lit("critical")).otherwise(F.lit("warning"))


def runtime_regression(limits: Thresholds = Thresholds()) -> Column:
    """Duration against the baseline median."""
    duration, b = F.col("duration_seconds"), F.col("baseline")
    median = b["p50_duration"]
    ratio = F.try_divide(duration, median)
    message = fill(
        RUNTIME_MESSAGE,
        now=fixed(duration, 1),
        median=fixed(median, 1),
        delta=fixed(duration - median, 1),
        ratio=fixed(ratio, 1),
    )
    return F.when(
        (duration > 0) & (ratio >= limits.runtime_warning),
        _finding(
            "job_runtime_regression",
            _severity(ratio >= limits.runtime_critical),
            message,
            F.lit(RUNTIME_ACTION),
            job_id=F.col("job_id"),
            duration_seconds=duration,
            baseline_p50_seconds=median,
            baseline_p95_seconds=b["p95_duration"],
            baseline_run_count=b["run_count"],
        ),
    )


def task_straggler(limits: Thresholds = Thresholds()) -> Column:
    """The most skewed job of the run, with the worst stage as a hint."""
    job, stage = F.col("skewed_job"), F.col("skewed_stage")
    job_id = F.coalesce(job["job_id"], F.col("job_id"))
    label = F.coalesce(F.nullif(job["job_name"], F.lit("")), job_id)
    hint = fill(
        STRAGGLER_STAGE,
        stage=stage["stage_id"],
        name=stage["name"],
        longest=shortest(stage["max_task_duration_ms"]),
        p95=shortest(stage["p95_task_duration_ms"]),
    )
    message = F.concat(
        fill(
            STRAGGLER_MESSAGE,
            label=label,
            ratio=fixed(job["ratio"], 2),
        ),
        F.when(stage.isNotNull(), hint).otherwise(F.lit("")),
    )
    action = F.when(
        stage.isNotNull(),
        fill(STRAGGLER_STAGE_ACTION, stage=stage["stage_id"], name=stage["name"]),
    ).otherwise(F.lit(STRAGGLER_ACTION))
    stage_evidence = F.when(
        stage.isNotNull(),
        _struct(
            STAGE_EVIDENCE,
            {
                "stage_id": stage["stage_id"],
                "stage_name": stage["name"],
                "max_task_duration_ms": stage["max_task_duration_ms"],
                "p95_task_duration_ms": stage["p95_task_duration_ms"],
                "num_tasks": stage["num_tasks"],
            },
        ),
    )
    return F.when(
        job.isNotNull(),
        _finding(
            "task_straggler_detected",
            _severity(job["ratio"] >= limits.straggler_critical),
            message,
            action,
            job_id=job_id,
            ratio=job["ratio"],
            num_tasks=job["num_tasks"],
            p95_task_duration_ms=job["p95_task_duration_ms"],
            max_task_duration_ms=job["max_task_duration_ms"],
            stage=stage_evidence,
        ),
    )


def cost_rise(limits: Thresholds = Thresholds()) -> Column:
    """The cost measure that rose most over its average; vcores on a tie. ``ratio`` is
    NULL where neither rose above the limit."""
    b = F.col("baseline")

    def rise(order: int, name: str, current: Column, average: Column) -> Column:
        ratio = F.when(average > 0, F.try_divide(current, average))
        return F.struct(
            F.when(ratio > limits.cost_warning, ratio).alias("ratio"),
            F.lit(-order).alias("order"),
            F.lit(name).alias("metric"),
            current.alias("current"),
            average.alias("average"),
        )

    return F.array_max(
        F.array(
            rise(0, "vcore_seconds", F.col("app_vcore_seconds"), b["avg_app_vcore_seconds"]),
            rise(
                1, "memory_gb_seconds", F.col("app_memory_gb_seconds"), b["avg_app_memory_gb_seconds"]
            ),
        )
    )


def cost_regression(top: Column, limits: Thresholds = Thresholds()) -> Column:
    """A cost measure well above its average. ``top`` is ``cost_rise`` as a column."""
    ratio, metric = top["ratio"], top["metric"]
    label = F.replace(metric, F.lit("_"), F.lit(" "))
    message = fill(
        COST_MESSAGE,
        label=label,
        now=fixed(top["current"], 1),
        average=fixed(top["average"], 1),
        delta=fixed(top["current"] - top["average"], 1),
        ratio=fixed(ratio, 2),
    )
    return F.when(
        ratio.isNotNull(),
        _finding(
            "cost_regression",
            _severity(ratio >= limits.cost_critical),
            message,
            fill(COST_ACTION, metric=label, ratio=fixed(ratio, 2)),
            metric=metric,
            current=top["current"],
            baseline_average=top["average"],
            ratio=ratio,
        ),
    )


def cluster_rightsizing(limits: Thresholds = Thresholds()) -> Column:
    """Peak executors against provisioned workers."""
    profile, peak = F.col("cluster_profile"), F.col("executor_peak")
    workers = profile["total_workers"]
    used = F.when(workers > 0, F.try_divide(peak, workers))
    low = used < limits.utilization_low
    usage = fill(
        WORKERS_MESSAGE,
        peak=fixed(peak, 1),
        workers=workers,
    )
    cluster = F.col("cluster_name")
    message = F.when(
        low,
        F.concat(
            fill(UNDERUSED_MESSAGE, c=cluster, p=fixed(used * 100, 0)), usage
        ),
    ).otherwise(F.concat(fill(SATURATED_MESSAGE, c=cluster), usage))
    return F.when(
        low | (used >= limits.utilization_high),
        _finding(
            F.when(low, F.lit("cluster_underutilized")).otherwise(
                F.lit("cluster_capacity_near_limit")
            ),
            F.when(low, F.lit("info")).otherwise(F.lit("warning")),
            message,
            F.when(low, F.lit(UNDERUSED_ACTION)).otherwise(F.lit(SATURATED_ACTION)),
            executor_peak=peak,
            total_workers=workers,
            autoscaling_enabled=profile["autoscaling_enabled"],
        ),
    )


def add_findings(resolved: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Adds ``findings``, in detector order, and ``has_issues``: any warning or critical
    one; an info finding alone is no issue."""
    found = resolved.withColumn("cost_rise", cost_rise(limits)).withColumn(
        "findings",
        F.array_compact(
            F.array(
                runtime_regression(limits),
                task_straggler(limits),
                cost_regression(F.col("cost_rise"), limits),
                cluster_rightsizing(limits),
            )
        ),
    )
    return found.drop("cost_rise").withColumn(
        "has_issues",
        F.exists("findings", lambda f: f["severity"].isin("warning", "critical")),
    )


# What each detector tells as evidence. Absent values of a detector's own are stored as null.
_OWN = {
    "job_runtime_regression": (
        "job_id", "duration_seconds", "baseline_p50_seconds", "baseline_p95_seconds", "baseline_run_count",
    ),
    "task_straggler_detected": (
        "job_id", "ratio", "num_tasks", "p95_task_duration_ms", "max_task_duration_ms", "stage",
    ),
    "cost_regression": ("metric", "current", "baseline_average", "ratio"),
    "cluster_underutilized": ("executor_peak", "total_workers", "autoscaling_enabled"),
    "cluster_capacity_near_limit": ("executor_peak", "total_workers", "autoscaling_enabled"),
}

_SNAPSHOT = (
    "p50_duration",
    "p95_duration",
    "avg_duration",
    "avg_app_vcore_seconds",
    "avg_app_memory_gb_seconds",
    "avg_max_over_median_ratio",
    "p95_task_duration_ms",
    "run_count",
)


def _stored_evidence(finding: Column) -> Column:
    e = finding["evidence"]
    return F.coalesce(
        *(
            F.when(finding["kind"] == kind, F.to_variant_object(F.struct(*(e[n].alias(n) for n in names))))
            for kind, names in _OWN.items()
        )
    )


def anomaly_flags() -> Column:
    """The nested payload of a run: findings, cost, baseline, identity, advice. Objects are
    VARIANT, so that their JSON form keeps absent values as null; no baseline is ``{}``."""
    b = F.col("baseline")
    snapshot = F.when(b.isNotNull(), F.to_variant_object(F.struct(*(b[n].alias(n) for n in _SNAPSHOT))))
    return F.struct(
        F.transform(
            "findings",
            lambda f: F.struct(
                f["kind"].alias("kind"),
                f["severity"].alias("severity"),
                f["message"].alias("message"),
                _stored_evidence(f).alias("evidence"),
                f["action"].alias("action"),
            ),
        ).alias("findings"),
        F.col("cost_summary").alias("cost_summary"),
        F.coalesce(snapshot, F.parse_json(F.lit("{}"))).alias("baseline_reference"),
        F.col("job_id").alias("job_family"),
        F.col("run_identifier").alias("run_identifier"),
        F.transform("findings", lambda f: f["action"]).alias("recommendations"),
        F.col("has_issues").alias("has_issues"),
    )
