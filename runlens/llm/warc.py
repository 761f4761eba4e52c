"""WARC archives with a two-level capture index.

Writing: equal payloads are found by digest; the capture with the largest id keeps the
payload, the others become revisit records. Each task writes one archive file of single
gzip members into the shared folder. Captures are then sorted by their key, the reversed
host and the path, and packed into compressed blocks of some hundred lines; the first key
of each block goes to a sparse directory beside them.

Reading: a looked-up key finds its index file from the files' bounds (one per partition of
the sort), its block by binary search in that file's directory, and its line by binary
search in the block. Only then are records read, by byte range, in the order of the files.

A task names its files after itself and a random part, and the rows it returns name the
files; so what a lost or repeated task leaves behind is never read.

Defined cases: a null html is an empty payload; a null or odd URL has an empty host in its
key; repeated rows are written each, and of equal payloads every row with the largest id
is a response; null ids count as smallest; an empty table gives an empty archive and index;
only id, URL and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ascii_lower, new_folder, parts, stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_REVISIT_BYTES = 1000
BLOCK_LINES = 300
ROLL_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)

CAPTURE = "key string, page_id long, file string, at long, size long"
CAPTURE_TYPE = pa.schema(
    [("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]
)


def surt(url: Column) -> Column:
    """Reversed host labels, ``)``, then what follows the host without the fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), tail)


def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``; the last is null for responses."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes)
    firsts = (
        large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    # Written first: a join of two plain shuffles can split a hot digest's partition.
    firsts = stash(firsts, "digests")
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", surt(F.col("url")).alias("key"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    # Header values stand on one line.
    target = "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("Refers-To-Page-Id", str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """WARC fields with the stored ``HTTP-Content-Length``, and the payload that is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["HTTP-Content-Length"] = next(
        x.split(b": ", 1)[1].decode() for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")
    )
    return fields, payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Output:
    """A new file of this task in the shared folder."""

    def __init__(self, folder: str, ending: str):
        task = TaskContext.get()
        self.name = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.{ending}"
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        self.stream, self.at = store.open_output_stream(f"{path}/{self.name}", compression=None), 0

    def write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.stream.write(data)
        self.at += len(data)
        return at, len(data)

    def close(self) -> None:
        self.stream.close()


def write_records(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out = None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if out is not None and out.at >= ROLL_BYTES:
                out.close()
                out = None
            out = out or Output(folder, "warc.gz")
            data = _gzip(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
            rows.append((r["key"], r["page_id"], out.name, *out.write(data)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CAPTURE_TYPE.types, strict=True)],
                schema=CAPTURE_TYPE,
            )
    if out is not None:
        out.close()


FILES = "index_file string, low string, low_id long, high string, high_id long, n long"


def write_index(batches: Iterator[pa.RecordBatch], folder: str, block_lines: int) -> Iterator[pa.RecordBatch]:
    """Blocks and directory of this partition, whose rows are sorted; one row about them."""
    out, held, directory, low, high, n = None, [], [], None, None, 0

    def flush() -> None:
        nonlocal out, held
        out = out or Output(folder, "blocks")
        at, size = out.write(zlib.compress(json.dumps(held).encode(), 6))
        directory.append((held[0][0], held[0][1], at, size))
        held = []

    for batch in batches:
        for key, page_id, file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sort_id = NO_ID if page_id is None else page_id
            low, high, n = low or (key, sort_id), (key, sort_id), n + 1
            held.append((key, sort_id, file, at, size))
            if len(held) >= block_lines:
                flush()
    if held:
        flush()
    if out is not None:
        # The directory is the file's last part, and its place the last twenty bytes.
        at, size = out.write(zlib.compress(json.dumps(directory).encode(), 6))
        out.write(b"%020d" % size)
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"index_file": [out.name], "low": [low[0]], "low_id": [low[1]], "high": [high[0]], "high_id": [high[1]], "n": [n]}
        )


@dataclass(frozen=True)
class Archive:
    """Where the archives and their index stand, and the bounds of the index files."""

    records: str
    index: str
    files: DataFrame


def write(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    block_lines: int = BLOCK_LINES,
) -> Archive:
    """Write all pages as WARC records and index them."""
    spark = pages.sparkSession
    records, index = new_folder(spark, "warc"), new_folder(spark, "cdx")
    rows = decide(pages, id_col, url_col, html_col, min_revisit_bytes)
    captures = stash(rows.mapInArrow(lambda b: write_records(b, records), CAPTURE), "captures")
    order = ["key", "page_id", "file", "at"]
    files = (
        captures.repartitionByRange(parts(spark), *order)
        .sortWithinPartitions(*order)
        .select(*(c.split()[0] for c in CAPTURE.split(", ")))
        .mapInArrow(lambda b: write_index(b, index, block_lines), FILES)
    )
    return Archive(records, index, stash(files, "cdx-files"))


class Input:
    """A file of the shared folder, read by ranges."""

    def __init__(self, folder: str, name: str):
        store, path = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{path}/{name}")

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def directory(self) -> list:
        end = self.file.size() - 20
        size = int(self.read(end, 20))
        return json.loads(zlib.decompress(self.read(end - size, size)))


def search(folder: str, name: str, wanted: list[tuple[str, int | None]]) -> Iterator[tuple]:
    """The index lines of the wanted ``(key, id)``; an id of None stands for all of the key."""
    file, block_at, block = Input(folder, name), None, []
    directory = file.directory()
    starts = [(d[0], d[1]) for d in directory]
    for key, own in sorted(wanted, key=lambda x: (x[0], NO_ID if x[1] is None else x[1])):
        low = (key, NO_ID if own is None else own)
        high = (key, (1 << 63) - 1 if own is None else own)
        # Lines that equal a block's first may begin in the block before.
        first, last = max(0, bisect_left(starts, low) - 1), bisect_right(starts, high)
        for k in range(first, last):
            if block_at != k:
                block, block_at = json.loads(zlib.decompress(file.read(*directory[k][2:]))), k
            keys = [(x[0], x[1]) for x in block]
            yield from block[bisect_left(keys, low) : bisect_right(keys, high)]


def lookup(archive: Archive, queries: DataFrame, *, key_col: str = "key", id_col: str | None = None) -> DataFrame:
    """``key, page_id, file, at, size`` of the captures with one of the keys, or, with
    ``id_col``, with one of the keys and ids (a null id is an id of its own)."""
    # One row per partition of the sort: as many as the session's shuffle partitions at most.
    bounds = sorted(
        ((r.low, r.low_id), (r.high, r.high_id), r.index_file) for r in archive.files.collect()
    )
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]
    folder, exact = archive.index, id_col is not None
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) if exact else F.lit(None).cast("long")
    asked = queries.select(F.col(key_col).alias("key"), own.alias("own")).where("key IS NOT NULL").distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = (key, NO_ID if own is None else own)
                high = (key, (1 << 63) - 1 if own is None else own)
                out += [(bounds[k][2], key, own) for k in range(bisect_left(highs, low), bisect_right(lows, high))]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["index_file", "key", "own"]
            )

    def find(rows: pa.Table) -> pa.Table:
        name = rows.column("index_file")[0].as_py()
        wanted = zip(rows.column("key").to_pylist(), rows.column("own").to_pylist(), strict=True)
        lines = [
            (k, None if i == NO_ID else i, f, at, size) for k, i, f, at, size in search(folder, name, list(wanted))
        ]
        columns = list(zip(*lines, strict=True)) or [()] * 5
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, CAPTURE_TYPE.types, strict=True)], schema=CAPTURE_TYPE
        )

    routed = asked.mapInArrow(route, "index_file string, key string, own long")
    return routed.groupBy("index_file").applyInArrow(find, CAPTURE)


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def fetch(archive: Archive, captures: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records of the captures, read by byte range in the order of the archive files.

    A response's length and digest are those of the payload that was read; a digest that
    differs from the record's ends the job. A revisit has what its record says.
    """
    folder = archive.records

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for own, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                if own != name:
                    name, file = own, Input(folder, own)
                fields, payload = parse(zlib.decompress(file.read(at, size), 31))
                stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                response = fields["WARC-Type"] == "response"
                if response and hashlib.sha1(payload).hexdigest() != stored:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                rows.append(
                    (
                        int(fields["Page-Id"]) if fields["Page-Id"] else None,
                        fields["WARC-Target-URI"],
                        fields["WARC-Type"],
                        len(payload) if response else int(fields["HTTP-Content-Length"]),
                        stored,
                        int(fields["Refers-To-Page-Id"]) if not response else None,
                        payload if with_payload and response else None,
                    )
                )
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=[c.split()[0] for c in RECORD.split(", ")],
            )

    n = parts(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(read, RECORD)
