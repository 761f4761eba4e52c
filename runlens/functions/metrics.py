"""Readings from the metric and cluster documents of a run."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import fixed as X
from runlens.functions import variant as V
from runlens.functions.wording import fixed


def _values(*names: str) -> str:
    return f"struct<{', '.join(f'{n}: variant' for n in names)}>"


_STAGE_TEXTS = ("stage_id", "stageId", "name", "stage_name")
_STAGE_COUNTS = ("num_tasks", "numTasks")
_STAGE_TIMES = ("max_task_duration_ms", "maxTaskDurationMs", "p95_task_duration_ms", "p95TaskDurationMs")

#: What this module reads of documents too large to be parsed whole (``variant.sections``).
METRIC_SECTIONS = {
    "app": _values(
        "app_vcore_seconds", "app_memory_gb_seconds", "executor_peak",
        "app_name", "name", "app_id", "application_id", "app_duration_ms", "duration_ms",
    ),
    "jobs": "array<" + _values(
        "job_id", "job_name", "name", "num_tasks", "job_duration_ms",
        "max_over_median_ratio", "p95_task_duration_ms", "max_task_duration_ms",
    ) + ">",
    "stages": f"array<{_values(*_STAGE_TEXTS, *_STAGE_COUNTS, *_STAGE_TIMES)}>",
    "metadata": "map<string, variant>",
}
_WORKERS = _values("numInstances", "machineTypeUri")
_CONFIG = f"struct<workerConfig: {_WORKERS}, secondaryWorkerConfig: {_WORKERS}, autoscalingConfig: variant>"
CLUSTER_SECTIONS = {"config": _CONFIG}
#: The same of stored cluster metrics, which hold a cluster document.
STORED_CLUSTER_SECTIONS = {
    "cluster_config_details": f"struct<config: {_CONFIG}>",
    "dataproc_cluster_uuid": "variant",
    "cluster_profile": "variant",
}


def cost_summary(v: Column) -> Column:
    """App cost fields, as the values stand in the document."""
    return F.struct(
        V.field(v, "$.app.app_vcore_seconds").alias("app_vcore_seconds"),
        V.field(v, "$.app.app_memory_gb_seconds").alias("app_memory_gb_seconds"),
        V.field(v, "$.app.executor_peak").alias("executor_peak"),
    )


def job_rows(v: Column) -> Column:
    """Job list; items that are no objects are wrapped as ``{"value": item}``."""
    return F.transform(
        V.objects(v, "$.jobs"),
        lambda x: F.when(V.is_object(x), x).otherwise(
            F.to_variant_object(F.named_struct(F.lit("value"), x))
        ),
    )


def first_job(jobs: Column) -> Column:
    """First object in the job list."""
    return V.first_object(jobs)


def job_sample(job: Column) -> Column:
    """Skew ratio and task p95 of one job."""
    return F.struct(
        V.number(job, "$.max_over_median_ratio").alias("ratio"),
        V.number(job, "$.p95_task_duration_ms").alias("p95_task_duration_ms"),
    )


def cluster_profile(v: Column) -> Column:
    """Worker counts, machine types and the autoscaling flag.

    Without a readable config the total is 0 and autoscaling false; fields that
    are NULL or empty text do not show in the JSON form.
    """
    primary = V.integer(v, "$.config.workerConfig.numInstances")
    secondary = V.integer(v, "$.config.secondaryWorkerConfig.numInstances")
    return F.struct(
        primary.alias("primary_workers"),
        secondary.alias("secondary_workers"),
        (F.coalesce(primary, F.lit(0)) + F.coalesce(secondary, F.lit(0))).alias("total_workers"),
        F.nullif(V.text(v, "$.config.workerConfig.machineTypeUri"), F.lit("")).alias(
            "primary_machine_type"
        ),
        F.nullif(V.text(v, "$.config.secondaryWorkerConfig.machineTypeUri"), F.lit("")).alias(
            "secondary_machine_type"
        ),
        V.truthy_text(v, "$.config.autoscalingConfig").isNotNull().alias("autoscaling_enabled"),
    )


def stage_rows(v: Column) -> Column:
    """Stages with snake or camel keys brought to one shape; no id, no row.

    A zero or empty first spelling falls through to the second one.
    """

    kinds = ((_STAGE_TEXTS, "string"), (_STAGE_COUNTS, "bigint"), (_STAGE_TIMES, "double"))
    spec = ",".join(f"{n}:{kind}" for names, kind in kinds for n in names)
    opened = F.transform(
        V.objects(v, "$.stages"),
        lambda x: F.struct(x.alias("raw"), V.fields(x, spec).alias("typed")),
    )

    def text(e: Column, first: str, second: str) -> Column:
        value = e["typed"][first]
        kept = V.certain(value) | V.truthy_text(e["raw"], f"$.{first}").isNotNull()
        return F.when(kept, value).otherwise(e["typed"][second])

    def numeric(e: Column, first: str, second: str) -> Column:
        value = e["typed"][first]
        kept = (value != 0) | V.truthy_text(e["raw"], f"$.{first}").isNotNull()
        chosen = F.when(kept, value).otherwise(e["typed"][second])
        return F.nanvl(chosen, F.lit(None)) if "duration" in first else chosen

    def shape(e: Column) -> Column:
        return F.struct(
            text(e, "stage_id", "stageId").alias("stage_id"),
            text(e, "name", "stage_name").alias("name"),
            numeric(e, "num_tasks", "numTasks").alias("num_tasks"),
            numeric(e, "max_task_duration_ms", "maxTaskDurationMs").alias("max_task_duration_ms"),
            numeric(e, "p95_task_duration_ms", "p95TaskDurationMs").alias("p95_task_duration_ms"),
        )

    return F.filter(F.transform(opened, shape), lambda s: s["stage_id"].isNotNull())


def _first_of_greatest(items: Column, score) -> Column:
    """The element with the greatest score, the first on ties, NULL without a score."""

    def scored(x: Column, i: Column) -> Column:
        value = score(x)
        return F.struct(value.alias("score"), F.when(value.isNotNull(), -i).alias("neg"))

    return F.get(items, -F.array_max(F.transform(items, scored))["neg"])


def worst_stage(stages: Column) -> Column:
    """The stage with the greatest max x (max / p95 where above 1); first on ties."""

    def score(s: Column) -> Column:
        longest = s["max_task_duration_ms"]
        spread = F.try_divide(longest, s["p95_task_duration_ms"])
        weighted = longest * F.when(spread > 1, spread).otherwise(F.lit(1.0))
        return F.when(weighted > -1, weighted)

    return _first_of_greatest(stages, score)


def worst_job(jobs: Column, above: float) -> Column:
    """The job with the greatest skew ratio above a limit; first on ties."""

    def score(j: Column) -> Column:
        ratio = V.number(j, "$.max_over_median_ratio")
        return F.when(ratio > above, ratio)

    return _first_of_greatest(jobs, score)


def job_details(j: Column) -> Column:
    """What a finding tells of a job, NULL without a job."""
    return F.when(
        j.isNotNull(),
        F.struct(
            V.number(j, "$.max_over_median_ratio").alias("ratio"),
            V.truthy_text(j, "$.job_id").alias("job_id"),
            F.coalesce(V.truthy_text(j, "$.job_name"), V.text(j, "$.name")).alias("job_name"),
            V.integer(j, "$.num_tasks").alias("num_tasks"),
            V.number(j, "$.p95_task_duration_ms").alias("p95_task_duration_ms"),
            V.number(j, "$.max_task_duration_ms").alias("max_task_duration_ms"),
        ),
    )


def format_metric(v: Column, path: str) -> Column:
    """Numbers to two decimals, text as it is, nothing as ``None``."""
    raw = V.field(v, path)
    value = V.text(v, path)
    numeric = F.coalesce(V.kind(raw).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|BOOLEAN)"), F.lit(False))
    return F.coalesce(
        F.when(numeric, fixed(V.field(v, path, "double"), 2)).otherwise(value), F.lit("None")
    )


def event_snippet(app: Column, job: Column, max_chars: int | None = None) -> Column:
    """Up to four text lines about the app and its first job, cut only where the caller
    gives ``max_chars``; NULL if there are none."""
    has_app = V.is_object(app) & (V.text(app, "$") != "{}")
    has_job = job.isNotNull() & (V.text(job, "$") != "{}")

    def either(first: str, second: str, default: str) -> Column:
        return F.coalesce(V.truthy_text(app, first), V.truthy_text(app, second), F.lit(default))

    def or_default(x: Column, path: str, default: str) -> Column:
        """Absent shows the default, an explicit null shows ``None``."""
        null_shown = F.when(F.is_variant_null(V.field(x, path)), F.lit("None"))
        return F.coalesce(V.text(x, path), null_shown, F.lit(default))

    duration = F.coalesce(
        V.truthy_text(app, "$.app_duration_ms"), V.text(app, "$.duration_ms"), F.lit("n/a")
    )
    def line(words: tuple[str, ...], *values: Column) -> Column:
        """The fixed words with the values between them."""
        parts = [p for w, v in zip_longest(words, values) for p in ((F.lit(w), v) if v is not None else (F.lit(w),))]
        return F.concat(*parts)

    app_line = line(
        X.SNIPPET_APP,
        either("$.app_name", "$.name", "unknown"),
        either("$.app_id", "$.application_id", "n/a"),
        duration,
        F.coalesce(V.text(app, "$.executor_peak"), F.lit("n/a")),
    )
    usage_line = line(
        X.SNIPPET_USAGE, format_metric(app, "$.app_vcore_seconds"), format_metric(app, "$.app_memory_gb_seconds")
    )
    has_usage = (
        V.text(app, "$.app_vcore_seconds").isNotNull()
        | V.text(app, "$.app_memory_gb_seconds").isNotNull()
    )
    job_line = line(
        X.SNIPPET_JOB,
        *(or_default(job, f"$.{n}", "n/a") for n in ("job_id", "num_tasks", "job_duration_ms", "p95_task_duration_ms")),
    )
    ratio_line = F.concat(F.lit(X.SNIPPET_RATIO), format_metric(job, "$.max_over_median_ratio"))
    lines = F.concat_ws(
        "\n",
        F.when(has_app, app_line),
        F.when(has_app & has_usage, usage_line),
        F.when(has_job, job_line),
        F.when(has_job & V.text(job, "$.max_over_median_ratio").isNotNull(), ratio_line),
    )
    whole = lines if max_chars is None else F.substring(lines, 1, max_chars)
    return F.nullif(whole, F.lit(""))


def enriched_metrics(raw: Column, v: Column, part: Column, run_id: Column, family: Column) -> Column:
    """Metric JSON text with ``metadata.run_identifier`` and ``metadata.job_family``
    added where absent. Documents without metadata, the common case, get it spliced
    into their text; only documents that have the section are rebuilt. Where ``part`` says
    that ``v`` has some sections only, a text with the section stays as it is."""
    body = F.regexp_replace(
        F.when(V.unreadable(raw, v), F.to_json(F.struct(raw.alias("unparsed"))))
        .when(v.isNull() | F.is_variant_null(v), F.lit("{}"))
        .when(V.is_object(v), raw)
        .otherwise(F.concat(F.lit('{"value":'), raw, F.lit("}"))),
        r"\}\s*$",
        "",
    )
    meta = F.to_json(F.struct(run_id.alias("run_identifier"), family.alias("job_family")))
    comma = F.when(body.rlike(r"^\s*\{\s*$"), F.lit("")).otherwise(F.lit(","))
    spliced = F.concat(body, comma, F.lit('"metadata":'), meta, F.lit("}"))

    existing = V.field(v, "$.metadata", "map<string,variant>")
    defaults = F.create_map(
        F.lit("run_identifier"), run_id.cast("variant"),
        F.lit("job_family"), family.cast("variant"),
    )
    merged = F.map_concat(
        existing, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(existing, k))
    )
    others = F.map_filter(
        V.field(v, "$", "map<string,variant>"), lambda k, _: k != F.lit("metadata")
    )
    rebuilt = F.to_json(
        F.map_concat(others, F.create_map(F.lit("metadata"), F.to_variant_object(merged)))
    )
    section = V.field(v, "$.metadata")
    return F.when(section.isNull(), spliced).when(existing.isNotNull() & ~part, rebuilt).otherwise(raw)
