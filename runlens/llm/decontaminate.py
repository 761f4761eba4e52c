"""Benchmark decontamination over a positional inverted index.

The corpus is indexed in segments of a few megabytes of text: for every term of a segment
the sorted places where it stands, counted in words over the whole segment. The index is a
table in the shared folder, one row per segment and term, so it is built in one pass without
a shuffle and can be asked again. A query reads only the rows of its own terms, brings them
together by segment and intersects the lists, shifted by each term's offset in the phrase,
from the rarest term on; most phrases end after one or two lists. A segment has a bounded
size, so a passage that stands in a third of all documents is spread like all other text.

The query set is collected in blocks of bounded size, each broadcast once (``BLOCK_CHARS``);
terms are broadcast for the index lookup only up to ``BROADCAST_TERMS``.

Defined cases: null and empty texts, on either side, have no words; an item of fewer words
than the window, but not none, is one window; items with equal texts are all reported; a null
item id marks hits but is not listed; ids of documents may be null or repeated, every row is
answered; only id and text are read, and ``clean`` gives all other columns back unchanged.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ascii_lower, fresh, hinted, new_folder, stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 10
SEGMENT_BYTES = 8 << 20
BLOCK_CHARS = 16 << 20
BROADCAST_TERMS = 200_000
#: Words of benchmark items, as Spark's pattern; ``TABLE`` says the same of bytes.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)
#: The row of a segment that lists its documents; no term is empty.
DOCUMENTS = b""
INDEX_SCHEMA = "segment long, term binary, n int, places binary, doc_ids array<long>, keys array<long>"
INDEX_TYPE = pa.schema(
    [
        ("segment", pa.int64()),
        ("term", pa.binary()),
        ("n", pa.int32()),
        ("places", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("keys", pa.list_(pa.int64())),
    ]
)


def split_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one binary array, and the number of the first word of each
    text, with the total at the end."""
    encoded = [(t or "").encode() for t in texts]
    raw = b" ".join(encoded).translate(TABLE)
    sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    letters = np.frombuffer(raw, np.uint8)
    inside = letters != 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    data = pa.py_buffer(letters[inside].tobytes())
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), data])
    return words, np.searchsorted(starts, begins)


def _segment_rows(number: int, ids: list, keys: list, texts: list) -> pa.RecordBatch:
    words, firsts = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.sort((codes << 32) | np.arange(len(codes), dtype=np.int64))
    places = (order & 0xFFFFFFFF).astype(np.int32)
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    # Steps between neighbours are small numbers, which the table's compression likes.
    steps = np.diff(places, prepend=np.int32(0))
    steps[bounds[:-1]] = places[bounds[:-1]]
    n = len(counts)
    lists = pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(steps.tobytes())]
    )
    terms = pa.concat_arrays([pa.array([DOCUMENTS], pa.binary()), coded.dictionary])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number, np.int64)),
            terms,
            pa.array(np.concatenate(([len(ids)], counts)).astype(np.int32)),
            pa.concat_arrays([pa.array([firsts.astype(np.int32).tobytes()], pa.binary()), lists]),
            pa.concat_arrays([pa.array([ids], pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]),
            pa.concat_arrays([pa.array([keys], pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]),
        ],
        schema=INDEX_TYPE,
    )


def index_batches(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Segments of this partition's documents."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    ids, keys, texts, held = [], [], [], 0
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
        for doc_id, key, text in rows:
            ids.append(doc_id)
            keys.append(key)
            texts.append(text)
            held += 4 * len(text or "") + 64
            if held >= 4 * segment_bytes:
                yield _segment_rows(number, ids, keys, texts)
                number, ids, keys, texts, held = number + 1, [], [], [], 0
    if ids:
        yield _segment_rows(number, ids, keys, texts)


def build(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """The index of all documents, written to the shared folder."""
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")
    )
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "postings")
    rows = narrow.mapInArrow(lambda batches: index_batches(batches, segment_bytes), INDEX_SCHEMA)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def phrase_block(items: list[tuple[str | None, str | None]], width: int) -> dict:
    """The windows of a block of items: its ``terms``, and by length the ``windows`` as a
    matrix of term numbers, with the items that have each. Plain values, which tasks can read
    without a copy of this package."""
    terms: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set] = {}
    words, firsts = split_words([text for _, text in items])
    listed = words.to_pylist()
    for (item, _), a, b in zip(items, firsts, firsts[1:], strict=False):
        codes = [terms.setdefault(w, len(terms)) for w in listed[a:b]]
        for i in range(max(1, len(codes) - width + 1) if codes else 0):
            windows.setdefault(tuple(codes[i : i + width]), set()).add(item)
    out = []
    for length in sorted({len(w) for w in windows}):
        own = [w for w in windows if len(w) == length]
        out.append((np.array(own, np.int32), [windows[w] for w in own]))
    return {"terms": list(terms), "windows": out}


def intersect(lists: list[np.ndarray]) -> np.ndarray:
    """Starts of the phrase whose term at each offset stands at the places of ``lists``."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        at = np.searchsorted(lists[k], starts + k)
        at[at == len(lists[k])] = 0
        starts = starts[lists[k][at] == starts + k]
    return starts


def near(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Places ``s`` of any of the terms such that all of them stand in ``[s, s + slop)``."""
    starts = np.unique(np.concatenate(lists))
    for places in sorted(lists, key=len):
        starts = starts[np.searchsorted(places, starts + slop) > np.searchsorted(places, starts)]
    return starts


class Segment:
    """The rows of one segment that a query needs."""

    def __init__(self, rows: pa.Table):
        self.places: dict[bytes, np.ndarray] = {}
        for term, places, ids, keys in zip(
            *(rows.column(c).to_pylist() for c in ("term", "places", "doc_ids", "keys")), strict=True
        ):
            numbers = np.frombuffer(places, np.int32)
            if term == DOCUMENTS:
                self.firsts, self.ids, self.keys = numbers, ids, keys
            else:
                self.places[term] = np.cumsum(numbers, dtype=np.int64)

    def inside(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts from which ``width`` words lie in one document, and these documents."""
        doc = np.searchsorted(self.firsts, starts, "right") - 1
        ok = starts + width <= self.firsts[doc + 1]
        return starts[ok], doc[ok]

    def phrases(self, block: dict) -> Iterator[tuple[int, set, np.ndarray, np.ndarray]]:
        """Length, items, starts and documents of the windows that occur."""
        none = np.empty(0, np.int64)
        lists = [self.places.get(t, none) for t in block["terms"]]
        there = np.array([len(x) > 0 for x in lists])
        for matrix, items in block["windows"]:
            length = matrix.shape[1]
            # One look at all windows: few have all their words in a segment.
            for k in np.flatnonzero(there[matrix].all(axis=1)).tolist():
                starts = intersect([lists[c] for c in matrix[k].tolist()])
                if len(starts):
                    starts, docs = self.inside(starts, length)
                    if len(starts):
                        yield length, items[k], starts, docs


def _blocks(queries: DataFrame, id_col: str, text_col: str, block_chars: int, width: int) -> list:
    items = queries.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + chars // block_chars
    context, out = queries.sparkSession.sparkContext, []
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()
        out.append(context.broadcast(phrase_block([(r.i, r.t) for r in block], width)))
    return out


def _wanted(index: DataFrame, queries: DataFrame, text_col: str, limit: int) -> DataFrame:
    """The index rows of the queries' terms, and every segment's list of documents."""
    words = F.explode(F.split(ascii_lower(F.col(text_col)), SEPARATORS)).alias("w")
    # Splitting leaves an empty word, which is the list of documents, or it is added.
    terms = queries.select(words).distinct().union(queries.sparkSession.sql("SELECT '' AS w"))
    terms = terms.distinct().select(F.col("w").cast("binary").alias("term"))
    return index.join(hinted(terms, limit), "term", "left_semi")


def contamination(
    index: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "item_id",
    text_col: str = "text",
    width: int = WIDTH,
    block_chars: int = BLOCK_CHARS,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Per document: ``doc_id, key, n_words, n_hit, items``. ``key`` is the text's xxhash64."""
    blocks = _blocks(queries, id_col, text_col, block_chars, width)

    def judge(rows: pa.Table) -> pa.Table:
        segment = Segment(rows)
        counts = np.diff(segment.firsts)
        items: list[set] = [set() for _ in counts]
        change = np.zeros(int(segment.firsts[-1]) + 1, np.int32)
        for block in blocks:
            for length, named, starts, docs in segment.phrases(block.value):
                np.add.at(change, starts, 1)
                np.add.at(change, starts + length, -1)
                for doc in np.unique(docs):
                    items[doc] |= named
        hit = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))
        return pa.table(
            {
                "doc_id": pa.array(segment.ids, pa.int64()),
                "key": pa.array(segment.keys, pa.int64()),
                "n_words": pa.array(counts.astype(np.int64)),
                "n_hit": pa.array((hit[segment.firsts[1:]] - hit[segment.firsts[:-1]]).astype(np.int64)),
                "items": pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
            }
        )

    rows = _wanted(index, queries, text_col, broadcast_terms)
    return rows.groupBy("segment").applyInArrow(
        judge, "doc_id long, key long, n_words long, n_hit long, items array<string>"
    )


def matches(
    index: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "item_id",
    text_col: str = "text",
    width: int = WIDTH,
    slop: int | None = None,
    block_chars: int = BLOCK_CHARS,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """One row per match: ``doc_id, item_id, kind, start``, the word's number in the document.

    ``phrase`` rows are exact windows of ``width`` words; with ``slop``, ``near`` rows are
    places from which all words of a window stand within that many words, in any order.
    """
    blocks = _blocks(queries, id_col, text_col, block_chars, width)

    def search(rows: pa.Table) -> pa.Table:
        segment, found = Segment(rows), []

        def add(kind: str, named: set, starts: np.ndarray, docs: np.ndarray) -> None:
            for s, d in zip(starts.tolist(), docs.tolist(), strict=True):
                found.extend((segment.ids[d], item, kind, s - int(segment.firsts[d])) for item in named)

        for block in blocks:
            phrases = block.value
            for _, named, starts, docs in segment.phrases(phrases):
                add("phrase", named, starts, docs)
            terms = phrases["terms"]
            every = [(w, i) for matrix, items in phrases["windows"] for w, i in zip(matrix, items, strict=True)]
            for window, named in every if slop else ():
                lists = [segment.places.get(terms[c]) for c in set(window.tolist())]
                if all(x is not None for x in lists):
                    starts = near(lists, slop)
                    docs = np.searchsorted(segment.firsts, starts, "right") - 1
                    # A place near its document's end counts if all words come before the end.
                    whole = [
                        all(np.searchsorted(x, segment.firsts[d + 1]) > np.searchsorted(x, s) for x in lists)
                        for s, d in zip(starts, docs, strict=True)
                    ]
                    whole = np.array(whole, bool)
                    add("near", named, starts[whole], docs[whole])
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table(
            [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.string()),
                pa.array(columns[2], pa.string()),
                pa.array(columns[3], pa.int64()),
            ],
            names=["doc_id", "item_id", "kind", "start"],
        )

    rows = _wanted(index, queries, text_col, broadcast_terms)
    return rows.groupBy("segment").applyInArrow(search, "doc_id long, item_id string, kind string, start long")


def clean(
    docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """The documents without a word in any occurrence of a benchmark window, all columns kept."""
    found = contamination(build(docs, id_col=id_col, text_col=text_col), queries, **settings)
    i, k = fresh(docs, "hit_id"), fresh(docs, "hit_key")
    hits = stash(found.where("n_hit > 0").select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct(), "hits")
    same = docs[id_col].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(k))
    return docs.join(hinted(hits, BROADCAST_TERMS), same, "left_anti")
