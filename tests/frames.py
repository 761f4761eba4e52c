"""Small literal frames for the tests."""

import json
from datetime import date, datetime

RUN_SCHEMA = (
    "run_no long, run_date date, application_start_time timestamp_ntz, application_end_time timestamp_ntz,"
    " status string, dataproc_jobid string, dataproc_cluster_uuid string, spark_taskid string, spark_jobid string,"
    " cluster_config_details string, log_location string, application_id string, spark_event_metrics string"
)
NAMES = [c.split()[0] for c in RUN_SCHEMA.split(",")]


def run(no, **values):
    row = dict.fromkeys(NAMES)
    row.update(
        run_no=no,
        run_date=date(2024, 1, 1),
        application_start_time=datetime(2024, 1, 1, 0, no % 60),
        application_end_time=datetime(2024, 1, 1, 1, no % 60),
        status="SUCCEEDED",
        spark_jobid="etl_daily",
    )
    row.update(values)
    for c in ("cluster_config_details", "spark_event_metrics"):
        if isinstance(row[c], (dict, list)):
            row[c] = json.dumps(row[c])
    return tuple(row[n] for n in NAMES)


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), RUN_SCHEMA)
