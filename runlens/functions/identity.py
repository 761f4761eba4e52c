"""Job identity: suffix stripping, job family, run identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.fixed import SUFFIX_PATTERN


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_identifier(c: Column) -> Column:
    """Drop one run-specific suffix, either letter case; NULL reads as ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)" + SUFFIX_PATTERN, "")


def logical_id(c: Column) -> Column:
    """Drop one lower-case suffix; keep the id when nothing else is left."""
    return F.coalesce(non_empty(F.regexp_replace(c, SUFFIX_PATTERN, "")), c)


def job_family(job_id: Column, task_id: Column, app_id: Column) -> Column:
    return F.coalesce(
        *(non_empty(normalize_identifier(c)) for c in (job_id, task_id, app_id)), F.lit("")
    )


def run_identifier(job_id: Column, task_id: Column, app_id: Column) -> Column:
    return F.coalesce(*(non_empty(c) for c in (job_id, app_id, task_id)), F.lit(""))


def primary_job_id(job_id: Column, task_id: Column, app_id: Column) -> Column:
    return F.coalesce(
        non_empty(job_family(job_id, task_id, app_id)), run_identifier(job_id, task_id, app_id)
    )


def cluster_name(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
