"""Cluster and job snapshots from exported, nested platform tables.

Expected cluster columns: cluster_name, cluster_uuid, labels map, status struct<state,
state_start_time, history array<struct<state_start_time>>>, metrics struct<hdfs_metrics map,
yarn_metrics map>, config struct<software_config struct<image_version,
optional_components array, properties map>>.

Expected job columns: reference struct<job_id, project_id>, job_uuid, type, labels map,
placement struct<cluster_name, cluster_uuid>, status struct<state, substate, start_time,
end_time, state_start_time>, status_history array<struct<state, state_start_time, details>>,
yarn_applications array<struct<application_id, name>>, driver_output_resource_uri,
driver_control_files_uri.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.clock import as_utc, iso_utc, kind_of, ntz_literal, utc
from runlens.functions.identity import non_empty


def cluster_snapshots(clusters: DataFrame, project_id: str, region: str) -> DataFrame:
    """One flat-topped row per cluster; creation is the first history entry's start."""
    created = as_utc(
        F.get(F.col("status.history"), F.lit(0))["state_start_time"],
        kind_of(clusters, "status.history.state_start_time"),
    )
    software = F.col("config.software_config")
    return clusters.select(
        F.lit(project_id).alias("project_id"),
        F.lit(region).alias("region"),
        "cluster_name",
        F.col("cluster_uuid").alias("uuid"),
        F.coalesce(F.col("status.state"), F.lit("UNKNOWN")).alias("status"),
        F.when(
            software.isNotNull(),
            F.struct(
                software["image_version"].alias("image_version"),
                software["optional_components"].alias("optional_components"),
                software["properties"].alias("properties"),
            ),
        ).alias("software_config"),
        F.when(
            F.col("metrics").isNotNull(),
            F.struct(F.col("metrics.hdfs_metrics"), F.col("metrics.yarn_metrics")),
        ).alias("metrics"),
        F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>")).alias("labels"),
        non_empty(F.col("cluster_uuid")).alias("cluster_uuid"),
        iso_utc(created).alias("create_time"),
        iso_utc(utc(clusters, "status.state_start_time")).alias("update_time"),
    )


def _yarn_ids(apps: Column) -> Column:
    """Application id, else name, of each application; empty ones dropped."""
    ids = F.transform(
        apps, lambda a: F.coalesce(non_empty(a["application_id"]), non_empty(a["name"]))
    )
    return F.coalesce(
        F.filter(ids, lambda x: x.isNotNull()), F.array().cast("array<string>")
    )


def job_snapshots(jobs: DataFrame, project_id: str, region: str) -> DataFrame:
    """One row per job, with YARN ids, status history and reference."""
    ref_id = non_empty(F.col("reference.job_id"))
    entered = kind_of(jobs, "status_history.state_start_time")
    history = F.transform(
        "status_history",
        lambda s: F.struct(
            s["state"].alias("state"),
            iso_utc(as_utc(s["state_start_time"], entered)).alias("state_start_time"),
            s["details"].alias("details"),
        ),
    )
    status = F.col("status")
    return jobs.select(
        F.lit(project_id).alias("project_id"),
        F.lit(region).alias("region"),
        F.coalesce(ref_id, F.col("job_uuid")).alias("job_id"),
        F.col("type").alias("job_type"),
        non_empty(F.col("placement.cluster_name")).alias("cluster_name"),
        non_empty(F.col("placement.cluster_uuid")).alias("cluster_uuid"),
        F.when(
            ref_id.isNotNull(),
            F.struct(
                ref_id.alias("job_id"),
                F.col("reference.project_id").alias("project_id"),
                F.lit(region).alias("region"),
            ),
        ).alias("reference"),
        F.when(status.isNull(), F.lit("UNKNOWN")).otherwise(status["state"]).alias("state"),
        status["substate"].alias("substate"),
        F.col("driver_output_resource_uri").alias("driver_output_uri"),
        F.col("driver_control_files_uri").alias("driver_control_files_uri"),
        iso_utc(utc(jobs, "status.start_time")).alias("start_time"),
        iso_utc(utc(jobs, "status.end_time")).alias("end_time"),
        iso_utc(utc(jobs, "status.state_start_time")).alias("state_timestamp"),
        _yarn_ids(F.col("yarn_applications")).alias("yarn_application_ids"),
        F.coalesce(history, F.array().cast(
            "array<struct<state:string,state_start_time:string,details:string>>"
        )).alias("status_history"),
        F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>")).alias("labels"),
    )


def submission_time(jobs: DataFrame) -> Column:
    """Start of the present state, else start of the first history entry, as UTC."""
    return F.coalesce(
        utc(jobs, "status.state_start_time"),
        as_utc(
            F.get(F.col("status_history"), F.lit(0))["state_start_time"],
            kind_of(jobs, "status_history.state_start_time"),
        ),
    )


def jobs_in_window(jobs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Jobs submitted in the closed window; a job without a time is kept as well."""
    t = submission_time(jobs)
    return jobs.where(t.isNull() | t.between(ntz_literal(start), ntz_literal(end)))
