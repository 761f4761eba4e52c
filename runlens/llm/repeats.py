"""Passages that stand in the corpus more than once, found level by level.

A window is ``width`` consecutive words. It can only occur twice if each shorter window in
it does, so the search starts with short ones and goes on, at twice their length, with
those that were not decided by what they have in common with others:

1. Levels are ``width`` halved until it is short, read upwards: 9, 18, 35 words for 35.
2. At a level every window is named after the least hash of the level's short windows in
   it, its anchor. Equal windows have equal anchors at the same place. Neighbouring windows
   share an anchor; such a run, a chunk, is one row with a 128-bit hash of all its words.
   There is a chunk for every dozen words, which is what the first level shuffles.
3. An anchor that occurs once decides its chunk: nothing in it repeats. An anchor all of
   whose chunks are equal decides them too: everything in them repeats. Otherwise the
   *different* chunks of the anchor go to the next level, one row for each content with its
   number of copies; contents that occur twice are settled and go on as witnesses only.
4. At ``width`` words a chunk is one window, and no candidate survives.

Only aggregates are taken by anchor and by content, so a passage that a third of all
documents hold is counted where it is read. What does not repeat is sent back by document,
and each document keeps the words that no repeated window covers. Both joins with the
documents are joins of plain tables, whose hot partitions are split.

Defined cases: a null or empty text has no words and nothing removed; a text of fewer words
than ``width`` has no window; rows with equal id and text are separate documents that repeat
each other; ids may be null; an empty table gives no rows; only id and text are read. Words
are compared as they stand, split at ASCII white space. Passages are compared by 128 bits of
hash, of which no two different ones are expected to agree below 10**18 passages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 35
#: The first level is not shorter than this.
SHORTEST = 8
BATCH_BYTES = 4 << 20
ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
CHUNKS = "doc_id long, h long, of int, start int, n int, weight int, anchor long, c1 long, c2 long"
PIECES = "doc_id long, h long, start int, n int, weight int, anchor long, words binary"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
BLANK = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def levels(width: int, shortest: int = SHORTEST) -> list[int]:
    """``width`` and its halves, ascending."""
    out = [width]
    while (half := -(-out[0] // 2)) >= shortest and half < out[0]:
        out.insert(0, half)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes all their bits depend on each other."""
    for factor in MIX:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text's words begin, with the end."""
    encoded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join(encoded).translate(BLANK), np.uint8)
    begins = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    edges = np.flatnonzero(np.diff((raw != 32).astype(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    data = pa.py_buffer(raw[raw != 32].tobytes())
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), data]).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64)
    hashes = known[words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.uint64)
    return hashes, np.searchsorted(starts, begins)


class Ranges:
    """Hashes of any ranges of a sequence, in one step each, from running sums."""

    def __init__(self, hashes: np.ndarray, odd: int):
        powers = np.full(len(hashes) + 1, odd, np.uint64)
        powers[0] = 1
        inverse = np.full(len(hashes) + 1, pow(odd, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers)[:-1])))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = (stop - start).astype(np.uint64)
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + length)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values the place of the least, the first one on ties."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def chunk_rows(
    hashes: np.ndarray, spans: np.ndarray, anchored: np.ndarray, level: int, width: int
) -> tuple[np.ndarray, ...]:
    """Chunks of the windows that start in ``spans``, rows of (first start, number of starts):
    per chunk its span, first start, number of starts, anchor and two content hashes.
    ``anchored`` has the anchor that each span was given at the level before."""
    none = np.empty(0, np.int64)
    if not len(spans):
        return none, none, none, none, none, none
    first, second = Ranges(hashes, ODD[0]), Ranges(mixed(hashes + np.uint64(ODD[1])), ODD[1])
    if level < width:
        short = first.of(np.arange(len(hashes) - level + 1), np.arange(level, len(hashes) + 1))
        places = least_places(short, width - level + 1)
    number = np.repeat(np.arange(len(spans)), spans[:, 1])
    starts = np.arange(len(number)) + np.repeat(spans[:, 0] - np.cumsum(spans[:, 1]) + spans[:, 1], spans[:, 1])
    at = places[starts] if level < width else starts
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(number) != 0) | (np.diff(at) != 0))))
    span, begin, n = number[edge], starts[edge], np.diff(np.append(edge, len(number)))
    stop = begin + n - 1 + width
    anchor = short[at[edge]] if level < width else first.of(begin, stop)
    # The place inside the chunk is part of the name: it is equal for equal windows.
    anchor = mixed(anchor + anchored[span] * np.uint64(ODD[0]))
    return (
        span,
        begin,
        n,
        anchor.view(np.int64),
        first.of(begin, stop).view(np.int64),
        second.of(begin, stop).view(np.int64),
    )


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows in portions of about ``BATCH_BYTES`` of ``column``."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            held.append(part)
            size += part.column(column).nbytes
            if size >= BATCH_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _read(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, from their texts or from stored hashes, and where each row's begin."""
    if column == "text":
        return word_hashes(batch.column(column).to_pylist())
    stored = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(stored), np.uint64), np.cumsum([0, *(len(s) // 8 for s in stored)])


def chunks_of(source: DataFrame, column: str, level: int, width: int) -> DataFrame:
    """The chunks at ``level`` of all windows of documents (``text``) or pieces (``words``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, column):
            hashes, firsts = _read(batch, column)
            counts = np.maximum(np.diff(firsts) - width + 1, 0)
            rows = np.flatnonzero(counts)
            given = batch.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64)[rows]
            spans = np.column_stack((firsts[rows], counts[rows]))
            span, begin, n, anchor, c1, c2 = chunk_rows(hashes, spans, given, level, width)
            row = rows[span]
            take = pa.array(row)
            of = batch.column("start").take(take)
            start = of.to_numpy(zero_copy_only=False) + begin - firsts[row]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("h").take(take),
                    of,
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    batch.column("weight").take(take),
                    pa.array(anchor),
                    pa.array(c1),
                    pa.array(c2),
                ],
                names=_names(CHUNKS),
            )

    return source.mapInArrow(run, CHUNKS)


def pieces(source: DataFrame, column: str, wanted: DataFrame, width: int) -> DataFrame:
    """The ``wanted`` chunks with the hashes of their words, read where ``chunks_of`` read them."""
    chunk = F.struct("start", "n", "weight", "anchor")
    asked = wanted.select(
        F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"), F.col("of").alias("of_start"), chunk.alias("chunk")
    )
    asked = stash(asked.groupBy("of_id", "of_h", "of_start").agg(F.collect_list("chunk").alias("chunks")), "wanted")
    same = (
        source["doc_id"].eqNullSafe(asked["of_id"])
        & (source["h"] == asked["of_h"])
        & (source["start"] == asked["of_start"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, column):
            hashes, firsts = _read(batch, column)
            lists = batch.column("chunks")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            of = batch.column("start").to_numpy(zero_copy_only=False)[row]
            begin = firsts[row] + flat.field("start").to_numpy(zero_copy_only=False) - of
            stop = begin + flat.field("n").to_numpy(zero_copy_only=False) - 1 + width
            words = [hashes[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("h").take(take),
                    *(flat.field(c) for c in ("start", "n", "weight", "anchor")),
                    pa.array(words, pa.binary()),
                ],
                names=_names(PIECES),
            )

    return source.join(asked, same).select("doc_id", "h", "start", "chunks", column).mapInArrow(run, PIECES)


def _decided(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a level's chunks those that occur once, and the anchors whose chunks differ. The
    greatest value of a column is the value, where there is but one."""
    place = ("doc_id", "h", "start", "n")
    once, differ = F.col("total") == 1, (F.col("low1") != F.col("high1")) | (F.col("low2") != F.col("high2"))
    judged = (
        chunks.groupBy("anchor")
        .agg(
            F.sum("weight").alias("total"),
            *(F.max(c).alias(c) for c in place),
            F.min("c1").alias("low1"),
            F.max("c1").alias("high1"),
            F.min("c2").alias("low2"),
            F.max("c2").alias("high2"),
        )
        .where(once | differ)
        .select(once.alias("once"), "anchor", *place)
    )
    judged = stash(judged, "judged")
    return judged.where("once").select(*place), judged.where("NOT once").select("anchor")


def _contents(chunks: DataFrame) -> DataFrame:
    """One row per content, with its number of copies (2 stands for more) and one place."""
    columns = ("doc_id", "h", "of", "start", "n", "anchor")
    counted = chunks.groupBy("c1", "c2").agg(F.sum("weight").alias("total"), *(F.first(c).alias(c) for c in columns))
    return counted.select(*columns, F.least("total", F.lit(2)).cast("int").alias("weight"))


def unrepeated(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, h, start, n``: the windows of ``docs`` (``doc_id, h, text``) that occur once,
    as runs of ``n`` windows that start one after another."""
    source, column = docs.withColumns(
        {"start": F.lit(0), "weight": F.lit(1), "anchor": F.lit(0).cast("long")}
    ), "text"
    found = []
    for level in levels(width):
        chunks = stash(chunks_of(source, column, level, width), "chunks")
        if level == width:
            found.append(_contents(chunks).where("weight = 1").select("doc_id", "h", "start", "n"))
            break
        once, differing = _decided(chunks)
        found.append(once)
        candidates = stash(_contents(chunks.join(differing, "anchor")), "candidates")
        if candidates.where("weight = 1").isEmpty():
            break
        source, column = stash(pieces(source, column, candidates, width), "pieces"), "words"
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept, spans``. ``spans`` are the
    stretches of words, end exclusive, that repeated windows cover; ``kept`` has the others,
    joined by one blank."""
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")
    )
    runs = unrepeated(narrow, width).select(
        F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"), F.struct("start", "n").alias("run")
    )
    runs = stash(runs.groupBy("of_id", "of_h").agg(F.collect_list("run").alias("runs")), "unrepeated")
    same = narrow["doc_id"].eqNullSafe(runs["of_id"]) & (narrow["h"] == runs["of_h"])

    def strip(text: str | None, starts: np.ndarray, lengths: np.ndarray) -> tuple:
        raw = (text or "").encode().translate(BLANK)
        words = raw.split()
        windows = len(words) - width + 1
        change = np.zeros(max(windows, 0) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + lengths, -1)
        again = np.cumsum(change)[:-1] == 0
        if not again.any():
            return len(words), 0, b" ".join(words), []
        edge = np.zeros(len(words) + 1, np.int64)
        edge[: len(again)] += again
        edge[width : width + len(again)] -= again
        covered = np.cumsum(edge)[:-1] > 0
        bounds = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
        kept = b" ".join(compress(words, ~covered))
        return len(words), int(covered.sum()), kept, list(zip(bounds[::2], bounds[1::2], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in _portions(batches, "text"):
            lists = batch.column("runs")
            flat = lists.flatten()
            starts = flat.field("start").to_numpy(zero_copy_only=False)
            lengths = flat.field("n").to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(sizes)
            rows = [
                strip(t, starts[b - k : b], lengths[b - k : b]) if k else strip(t, none, none)
                for t, k, b in zip(batch.column("text").to_pylist(), sizes.tolist(), upto.tolist(), strict=True)
            ]
            n_words, n_removed, kept, spans = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array([k.decode() for k in kept], pa.string()),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], SPANS),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    joined = narrow.join(runs, same, "left").select("doc_id", "text", "runs")
    kinds = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>"
    return joined.mapInArrow(run, kinds)
