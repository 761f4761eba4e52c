"""Driver and container log selection over an exported log table.

Expected columns: timestamp, log_name, severity, resource_type, logger, cluster_name,
yarn_application_id, text_payload, message, resource_labels map, labels map, and a
unique entry id for stable order.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.fixed import (
    CONTAINER_LOGGER,
    CONTAINER_RESOURCE,
    DRIVER_LOGGER,
    DRIVER_RESOURCE,
)
from runlens.functions.clock import literal_for, utc
from runlens.functions.identity import non_empty
from runlens.operators.ranking import first_numbers, group_numbers
from runlens.storage import bounded, pin

# Chosen lines (time and id) up to this number are broadcast.
BROADCAST_LINES = 200_000
_EPOCH = datetime(1970, 1, 1)
# Microseconds of the least and the greatest moment of a literal.
_FIRST, _LAST = ((moment - _EPOCH) // timedelta(microseconds=1) for moment in (datetime.min, datetime.max))


def _select(logs: DataFrame, resource: str, logger: str, start: datetime, end: datetime):
    low, high = (literal_for(logs, "timestamp", m) for m in (start, end))
    return logs.where(
        (F.col("resource_type") == resource)
        & (F.col("logger") == logger)
        & F.col("timestamp").between(low, high)
    )


def driver_logs(
    logs: DataFrame, start: datetime, end: datetime, cluster_name: str | None = None
) -> DataFrame:
    """Driver log entries of one cluster, or of every cluster, in the closed window."""
    rows = _select(logs, DRIVER_RESOURCE, DRIVER_LOGGER, start, end)
    return rows if cluster_name is None else rows.where(F.col("cluster_name") == cluster_name)


def container_logs(
    logs: DataFrame, start: datetime, end: datetime, yarn_application_id: str | None = None
) -> DataFrame:
    """Container log entries of one application, or of every one, in the closed window."""
    rows = _select(logs, CONTAINER_RESOURCE, CONTAINER_LOGGER, start, end)
    if yarn_application_id is None:
        return rows
    return rows.where(F.col("yarn_application_id") == yarn_application_id)


def log_lines(
    entries: DataFrame, *, entry_id: str, limit: int | None = None, per: str | None = None
) -> DataFrame:
    """Entries in time order as log lines, numbered by ``line_no``; with ``limit`` the first ones.

    Text is the text payload, else the message field, else ''. With ``per`` number and
    limit hold for each value of that column. A value may have a third of all entries: its
    lines are numbered on narrow rows of time and id, in many tasks. With ``limit`` entries
    are not sorted but counted by time, the few lines within the limit are found among those
    up to the time they reach, and only entries up to then are read with their texts.
    """
    text = F.coalesce(non_empty(F.col("text_payload")), F.col("message"), F.lit(""))
    optional = [c for c in ("log_name", "resource_labels", "labels") if c in entries.columns]
    keys = [] if per is None else [per]
    if limit is None:
        narrow = entries.select(*keys, "timestamp", F.col(entry_id).alias("line_of"))
        chosen = group_numbers(narrow, keys, ["timestamp", "line_of"], "line_no").select("line_of", "line_no")
    else:
        micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH), utc(entries, "timestamp"))
        narrow = entries.select(*keys, micros.alias("line_at"), F.col(entry_id).alias("line_of"))
        numbered, end, most = first_numbers(narrow, keys, "line_at", "line_of", limit, "line_no")
        chosen = pin(numbered.select("line_of", "line_no"))
        chosen = F.broadcast(chosen) if most <= BROADCAST_LINES else bounded(chosen, BROADCAST_LINES)
        if isinstance(entries.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
            moment = _EPOCH + timedelta(microseconds=min(max(end, _FIRST), _LAST))
            latest = literal_for(entries, "timestamp", moment)
            entries = entries.where(F.col("timestamp").isNull() | (F.col("timestamp") <= latest))
    return entries.join(chosen, F.col(entry_id) == F.col("line_of")).select(
        *keys, "line_no", entry_id, "timestamp", "severity", text.alias("text"), *optional
    )
