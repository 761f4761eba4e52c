"""Event-log files by application id."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.fixed import EVENT_LOG_HINTS, MIN_EVENT_LOG_BYTES
from runlens.storage import bounded, pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Files are read in parts of at most so many bytes, one row each.
PART_BYTES = 128 << 20
#: Matched names up to this number are broadcast.
BROADCAST_NAMES = 200_000


def _prefix(prefix: str) -> str:
    return prefix.rstrip("/") + "/" if prefix.rstrip("/") else ""


def _cap(max_bytes: int | None) -> int | None:
    return None if max_bytes is None else max(max_bytes, MIN_EVENT_LOG_BYTES)


def match_names(names: DataFrame, application_ids: DataFrame, *, prefix: str = "") -> DataFrame:
    """``names`` with each ``application_id`` that the name has after ``prefix``, for names
    with a known hint.

    A prefix can only match at the length of some id. Ids have few lengths, so a name gives
    few join keys, and an id's own length keeps short beginnings that all names share out.
    """
    base = _prefix(prefix)
    hinted = names.where(
        F.col("name").startswith(base) & reduce(or_, [F.col("name").contains(h) for h in EVENT_LOG_HINTS])
    )
    ids = application_ids.toDF("application_id").where(F.length("application_id") > 0).distinct()
    # As many rows as ids have different lengths.
    lengths = sorted(r[0] for r in ids.select(F.length("application_id")).distinct().collect())
    tail = F.substr("name", F.lit(len(base) + 1))
    starts = F.transform(
        F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(tail)),
        lambda n: F.substr(tail, F.lit(1), n),
    )
    return hinted.withColumn("application_id", F.explode(starts)).join(ids, "application_id", "left_semi")


def _head(content: Column, size: Column, cap: int | None) -> list[Column]:
    cut = content if cap is None else F.substring(content, 1, cap)
    truncated = F.lit(False) if cap is None else size > cap
    return [F.make_valid_utf8(cut.cast("string")).alias("content_snippet"), truncated.alias("truncated")]


def select_event_logs(
    files: DataFrame, application_ids: DataFrame, *, prefix: str = "", max_bytes: int | None = None
) -> DataFrame:
    """Event logs of a table with ``name``, ``length`` and ``content``.

    A file is given once for each id it matches, whole, or with ``max_bytes`` cut to its
    first bytes (``truncated`` tells). Names are matched alone; contents stay where they are
    scanned while the matched names fit a broadcast.
    """
    matches = pin(match_names(files.select("name"), application_ids, prefix=prefix))
    return files.join(bounded(matches, BROADCAST_NAMES), "name").select(
        "application_id",
        F.col("name").alias("blob_name"),
        F.col("length").alias("size_bytes"),
        *_head(F.col("content"), F.col("length"), _cap(max_bytes)),
    )


def _whole_characters(file: pa.NativeFile, start: int, stop: int, end: int) -> bytes:
    """The bytes from ``start`` to ``stop``, but a character that ``stop`` cuts is taken whole
    and the rest of one that ``start`` cuts is left to the part before."""
    data = file.read_at(max(0, min(stop + 3, end) - start), start)

    def cut(at: int) -> int:
        """How many bytes from ``at`` on continue a character; four bytes are the longest."""
        n = 0
        while n < 3 and at + n < len(data) and 0x80 <= data[at + n] < 0xC0:
            n += 1
        return n

    first = cut(0) if start else 0
    return data[first : max(first, stop - start + cut(stop - start))]


def _read(batches: Iterator[pa.RecordBatch], cap: int | None, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of the files, opened here and read by ranges."""
    for batch in batches:
        for r in batch.to_pylist():
            # Listed local paths are not escaped, so they are given as paths and not as URIs.
            store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", r["path"]))
            end = r["length"] if cap is None else min(cap, r["length"])
            with store.open_input_file(path) as file:
                for k in range(max(1, -(-end // part_bytes))):
                    data = _whole_characters(file, k * part_bytes, min((k + 1) * part_bytes, end), end)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "application_id": pa.array([r["application_id"]], pa.string()),
                            "blob_name": pa.array([r["name"]], pa.string()),
                            "size_bytes": pa.array([r["length"]], pa.int64()),
                            "file_part": pa.array([k], pa.int32()),
                            "data": pa.array([data], pa.binary()),
                        }
                    )


def read_event_logs(
    spark: SparkSession,
    location: str | None,
    application_ids: DataFrame,
    *,
    prefix: str = "",
    max_bytes: int | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Event logs below a folder. Names are listed and matched without contents; a task then
    opens the matched files and reads them by ranges, in parts of ``part_bytes`` numbered by
    ``file_part``, so a file may have any size. Parts end between characters, so joined parts
    are the file's text. No location gives no rows."""
    found = "path string, length bigint"
    files = spark.createDataFrame([], found)
    if location:
        root = location.rstrip("/") + "/"
        try:
            files = (
                spark.read.format("binaryFile")
                .option("recursiveFileLookup", "true")
                .load(f"{root}{_prefix(prefix)}")
                .select("path", "length")
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        # The name of a file is its path below the location.
        below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root)
        at = F.locate(below, F.col("path")) + len(below)
        files = files.withColumn("name", F.substr("path", at))
    else:
        files = files.withColumn("name", F.lit(""))
    cap = _cap(max_bytes)
    matched = match_names(files, application_ids, prefix=prefix).select("application_id", "name", "path", "length")
    parts = matched.repartition("path").mapInArrow(
        lambda b: _read(b, cap, part_bytes),
        "application_id string, blob_name string, size_bytes long, file_part int, data binary",
    )
    return parts.select(
        "application_id", "blob_name", "size_bytes", "file_part", *_head(F.col("data"), F.col("size_bytes"), None)[:1],
        (F.lit(False) if cap is None else F.col("size_bytes") > cap).alias("truncated"),
    )
