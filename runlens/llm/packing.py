"""Packing documents into windows by minimum bin slack.

Documents are tokenised once, each ends with one end id, and is cut only where it is longer
than a window: full pieces are windows of their own, one shorter piece remains. Of these only
their length matters, and there are fewer lengths than a window has places. So the counts per
length are gathered (a bounded table, whatever the data's size), and the plan is made on them:
beginning with the longest remaining length, a bitset subset-sum over the multiset of shorter
ones finds the sum closest to the window, backtracking gives the count of each length, and the
pattern is repeated as often as the counts allow. Pieces of a length that leaves more than
``SLACK`` tokens open whatever is put beside it are cut into powers of two, which the same
method packs without a gap. Every piece finds its window from its rank among the pieces of
its length, which comes from prefix sums over the partitions.

Words repeat, so each distinct word is tokenised once and kept while the task's cache lasts.
Texts are cut for this only where the tokenizer itself never joins (``split_chunks``).

Defined cases: null and empty texts are one end id; documents may be repeated, each row is
packed; ids may be null; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 1
#: A window of whole pieces may lack so many tokens; pieces that fit none such are cut.
SLACK = 8
BATCH_CHARS = 4 << 20
CACHED_WORDS = 300_000
#: Words given to the tokenizer at once; its results are far larger than the ids kept.
ENCODED_AT_ONCE = 8_000
#: ASCII bytes by what they are to the tokenizer: white space, letters and digits, other signs.
#: The apostrophe may begin a word of its own, and bytes beyond ASCII may be anything.
SPACE, ALNUM, SIGN, OTHER = range(4)
CLASSES = bytes(
    SPACE if chr(b) in "\t\n\v\f\r " else OTHER if b >= 128 or chr(b) == "'" else ALNUM if chr(b).isalnum() else SIGN
    for b in range(256)
)


def split_chunks(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts that the tokenizer treats each by itself, and the number of each
    text's first piece, with the total.

    It drops white space and keeps words and runs of signs apart. A run of ASCII signs is
    cut out where ASCII letters, digits or white space stand on both sides; next to other
    characters it stays where it is, as it may belong to them. ASCII capitals are lowered as
    the tokenizer would, but before other characters, which may combine with the capital
    only. Texts that may spell a special token are cut at white space alone.
    """
    encoded = [(t or "").encode() for t in texts]
    joined = b" ".join(encoded) + b" "
    special = b"<|" in joined
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded)))))
    raw = np.frombuffer(joined, np.uint8)
    kind = np.frombuffer(joined.translate(CLASSES), np.uint8)
    inside = kind != SPACE
    breaks = np.diff(inside.astype(np.int8), prepend=0, append=0) != 0
    if not special:
        signs = np.flatnonzero(np.diff((kind == SIGN).astype(np.int8), prepend=0, append=0))
        first, last = signs[0::2], signs[1::2]  # last is behind the run, where at least a blank stands
        alone = (kind[last] <= ALNUM) & ((first == 0) | (kind[first - 1] <= ALNUM))
        breaks[first[alone]] = True
        breaks[last[alone]] = True
        capital = (raw >= 65) & (raw <= 90)
        capital[:-1] &= raw[1:] < 128
        raw = raw + (capital.astype(np.uint8) << 5)
    edges = np.flatnonzero(breaks)
    starts, ends = edges[:-1], edges[1:]
    words = inside[starts]
    starts, ends = starts[words], ends[words]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    data = pa.py_buffer(raw[inside].tobytes())
    chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), data])
    return chunks, np.searchsorted(starts, begins)


class Encoder:
    """Token ids of texts, through a cache of pieces in two generations of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _known(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {}, self.young
        young, parts = self.young, list(map(self.young.get, distinct))
        missing = [i for i, p in enumerate(parts) if p is None]
        for i in missing:
            parts[i] = self.old.get(distinct[i])
        new = [i for i in missing if parts[i] is None]
        for k in range(0, len(new), ENCODED_AT_ONCE):
            some = new[k : k + ENCODED_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([distinct[i].decode() for i in some], add_special_tokens=False)
            for i, e in zip(some, found, strict=True):
                parts[i] = np.array(e.ids, "<u4").tobytes()
        young.update((distinct[i], parts[i]) for i in missing)
        return parts

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin, with the total."""
        chunks, firsts = split_chunks(texts)
        coded = chunks.dictionary_encode()
        parts = self._known(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        take = np.repeat(begins[codes] - ends[:-1], counts) + np.arange(ends[-1])
        return flat[take], ends[firsts]


PIECES = (
    "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long, cuts array<long>,"
    " ids array<int>"
)


def ladder(length: int) -> list[int]:
    """Powers of two, the largest first, that make up the length."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def piece_batches(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    """Pieces of this partition's documents; ``nth`` counts the pieces of one length."""
    encoder, task = Encoder(path), TaskContext.get()
    part = task.partitionId() if task else 0
    seen = np.zeros(capacity + 1, np.int64)

    def pieces(doc_ids: list, texts: list) -> pa.RecordBatch:
        ids, bounds = encoder.ids(texts)
        rows = []
        for doc_id, a, b in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
            for s in range(0, len(whole), capacity):
                piece = whole[s : s + capacity]
                n = len(piece)
                own = piece.astype(np.int32) if with_ids else None
                cuts, at = [], 0
                for step in ladder(n) if n < capacity else ():
                    cuts.append(zlib.crc32(piece[at : at + step].tobytes()))
                    at += step
                rows.append((doc_id, s, n, zlib.crc32(piece.tobytes()), len(whole), part, int(seen[n]), cuts, own))
                seen[n] += 1
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        kinds += (pa.list_(pa.int64()), pa.list_(pa.int32()))
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
        )

    held, doc_ids, texts = 0, [], []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc_ids.append(doc_id)
            texts.append(text)
            held += len(text or "") + 16
            if held >= BATCH_CHARS:
                yield pieces(doc_ids, texts)
                held, doc_ids, texts = 0, [], []
    if doc_ids:
        yield pieces(doc_ids, texts)


def best_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the multiset ``counts``, how many of each length give the largest sum up to ``room``."""
    full = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        left, size = min(counts[length], room // length), 1
        while left:  # lengths in ones, twos, fours: every number up to the count
            take = min(size, left)
            reach |= (reach << (take * length)) & full
            left, size = left - take, 2 * size
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


@dataclass
class Patterns:
    """One entry for each length of each pattern, sorted by ``key``."""

    key: np.ndarray  # length << 44 | first rank that the entry takes
    each: np.ndarray  # pieces of that length in one window
    window: np.ndarray  # number of the pattern's first window
    offset: np.ndarray  # place of the first such piece in the window
    n_windows: int
    padding: int
    left: dict[int, int]  # per length, the first rank that no window has taken

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) | rank, "right") - 1
        local = rank - (self.key[at] & ((1 << 44) - 1))
        number, slot = local // self.each[at], local % self.each[at]
        return self.window[at] + number, self.offset[at] + slot * length


def patterns(histogram: dict[int, int], capacity: int, slack: int) -> Patterns:
    """Which lengths share a window. A length that cannot be filled up to ``slack`` is left."""
    left = {x: n for x, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    entries, over, windows, padding = [], {}, 0, 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_subset({x: n for x, n in rest.items() if n}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        total = sum(x * n for x, n in pattern.items())
        if capacity - total > slack:
            over[longest] = used[longest]
            del left[longest]
            continue
        times = min(left[x] // n for x, n in pattern.items())
        offset = 0
        for x in sorted(pattern, reverse=True):
            entries.append(((x << 44) | used[x], pattern[x], windows, offset))
            offset += x * pattern[x]
            used[x] += times * pattern[x]
            left[x] -= times * pattern[x]
            if not left[x]:
                del left[x]
        windows += times
        # A window whose length is a power of two needs no padding.
        padding += times * (0 if offset & (offset - 1) == 0 else capacity - offset)
    entries.sort()
    columns = np.array(entries, np.int64).reshape(-1, 4).T
    return Patterns(*columns, windows, padding, over)


@dataclass
class Plan:
    """Windows of whole pieces, and windows of the pieces that fitted none and are cut."""

    whole: Patterns
    cut: Patterns
    #: For a cut length, the number of the first part of each size of its ladder.
    first: dict[int, dict[int, int]]

    @property
    def n_windows(self) -> int:
        return self.whole.n_windows + self.cut.n_windows

    @property
    def padding(self) -> int:
        return self.whole.padding + self.cut.padding


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK) -> Plan:
    """``histogram`` has the number of pieces per length. What finds no window with little
    slack is cut into powers of two, of which all windows but the last are filled."""
    whole = patterns(histogram, capacity, slack)
    sizes: dict[int, int] = {}
    first: dict[int, dict[int, int]] = {}
    for length, rank in sorted(whole.left.items()):
        first[length] = {}
        for step in ladder(length):
            first[length][step] = sizes.get(step, 0)
            sizes[step] = sizes.get(step, 0) + histogram[length] - rank
    return Plan(whole, patterns(sizes, capacity, capacity), first)


def place_pieces(plan: Plan, rows: dict[str, list]) -> dict[str, list]:
    """The pieces, cut where the plan says so, with ``sequence_id`` and ``offset``."""
    out: dict[str, list] = {c: [] for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "ids", "length", "rank")}
    cut = {c: [] for c in out}
    for r in zip(*(rows[c] for c in (*out, "cuts")), strict=True):
        length, rank = r[5], r[6]
        if rank < plan.whole.left.get(length, rank + 1):
            for c, v in zip(out, r, strict=False):
                out[c].append(v)
            continue
        at = 0
        for step, crc in zip(ladder(length), r[7], strict=True):
            ids = r[4][at : at + step] if r[4] is not None else None
            number = plan.first[length][step] + rank - plan.whole.left[length]
            for c, v in zip(cut, (r[0], r[1] + at, crc, r[3], ids, step, number), strict=True):
                cut[c].append(v)
            at += step
    windows: list[int] = []
    offsets: list[int] = []
    for part, found, begun in ((out, plan.whole, 0), (cut, plan.cut, plan.whole.n_windows)):
        if part["length"]:
            w, o = found.place(np.array(part["length"], np.int64), np.array(part["rank"], np.int64))
            windows += (w + begun).tolist()
            offsets += o.tolist()
    both = {c: out[c] + cut[c] for c in out}
    return {**both, "sequence_id": windows, "offset": offsets}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and the
    token ``ids`` when asked for. ``tokenizer_path`` is a file that all executors have."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stash(
        narrow.mapInArrow(lambda b: piece_batches(b, tokenizer_path, capacity, end_id, with_ids), PIECES), "pieces"
    )
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    # At most one row per length of a window.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, capacity)

    kinds = {
        "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
        "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(),
    }
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = place_pieces(plan, batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in kinds.items()], names=list(kinds))

    out = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in kinds)
    return (
        pieces.join(ranks, ["length", "part"])
        .withColumn("rank", F.col("ahead") + F.col("nth"))
        .select("doc_id", "start", "ids_crc32", "doc_tokens", "ids", "length", "rank", "cuts")
        .mapInArrow(placed, out)
    )
