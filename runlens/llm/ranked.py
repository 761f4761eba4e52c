"""Ranked lexical search in which documents with equal bags are scored once.

Of a document, scoring sees how often it has each term of the asked items, and a length
factor m. Documents that agree in both are one class and get one score:

1. Each document is restricted to the vocabulary of the items: its bag, as sorted term
   numbers with their counts. Bags are written once; N and L are sums over them.
2. Bags with equal hash are compared in full and counted (``groupBy`` of hash, bag and m),
   which gives the classes and, from their sizes, the terms' document frequencies.
3. Every class is scored against all items in integers. A task keeps the ``top`` best
   classes of each item, by score and then least member; the best of all tasks follow.
   The ``top`` best documents are all in these classes, as each has a member before them.
4. Only the chosen classes are expanded. A task keeps the ``top`` least ids of a class, so a
   class that a third of all documents are in sends as little as any other.

Items are taken in blocks of ``BLOCK_CHARS`` characters, one at a time: a block's terms and
weights go to the tasks, and each block reads the documents once.

Defined cases: null and empty texts, on either side, have no terms; an item without terms,
or without a document of score above 0, gives no rows; rows of items with equal ids are
ranked each on its own; a null document id comes after all others; repeated rows are
separate documents; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import hinted, stash
from runlens.llm.decontaminate import split_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 50
BLOCK_CHARS = 4 << 20
BATCH_BYTES = 4 << 20
#: Scores, and additions to scores, that a task holds at once.
CELLS = 1 << 21
BROADCAST_CLASSES = 200_000
#: Stands for a null id, so that it comes last.
LAST = (1 << 63) - 1
BEST = "item int, score long, h long, m long, first long, members long"


def blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """Items as ``(id, text)`` in blocks of about ``block_chars`` characters, one at a time."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > block_chars:
        items = stash(items.repartition(1 + chars // block_chars), "items")
    held, size = [], 0
    for row in items.toLocalIterator():  # one partition at a time, each about a block
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def terms_of(texts: list[str]) -> list[set[bytes]]:
    words, firsts = split_words(texts)
    return [set(words[a:b].to_pylist()) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]


def bags(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, bag``: a document's number of terms, and the numbers of those in ``codes``,
    ascending, followed by their counts; null if it has none of them."""

    def rows(ids: list, texts: list) -> pa.RecordBatch:
        words, firsts = split_words(texts)
        coded = words.dictionary_encode()
        known = np.fromiter((codes.get(w, -1) for w in coded.dictionary.to_pylist()), np.int64)
        n = np.diff(firsts)
        code = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(texts)), n)
        cells, counts = np.unique((row * len(codes) + code)[code >= 0], return_counts=True)
        bounds = np.searchsorted(cells, np.arange(len(texts) + 1) * len(codes))
        numbers, counts = (cells % len(codes)).astype(np.int32), counts.astype(np.int32)
        found = [
            numbers[a:b].tobytes() + counts[a:b].tobytes() if b > a else None
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), pa.array(found, pa.binary())],
            names=["doc_id", "n", "bag"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text or "")
                if size >= BATCH_BYTES:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)

    return docs.mapInArrow(run, "doc_id long, n long, bag binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bags: the row, term number and count of all their entries."""
    stored = column.to_pylist()
    half = np.fromiter((len(b) // 8 for b in stored), np.int64, len(stored))
    numbers = np.frombuffer(b"".join(stored), np.int32).astype(np.int64)
    row = np.repeat(np.arange(len(stored)), half)
    at = np.arange(len(row)) + np.repeat(np.cumsum(half) - half, half)
    return row, numbers[at], numbers[at + half[row]]


def class_table(held: DataFrame, documents: int, terms: int) -> DataFrame:
    """``held`` bags with their length factor ``m`` and the hash ``h`` of both."""
    m = F.expr(f"50L + (50L * n * {documents}L) div {terms}L")
    keyed = held.where("bag IS NOT NULL").withColumn("m", m)
    return keyed.withColumn("h", F.xxhash64("bag", "m")).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))


def frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Per term the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            row, code, _ = _flat(batch.column(0))
            np.add.at(total, code, batch.column(1).to_numpy()[row])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["code", "df"])

    counted = classes.select("bag", "members").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df"))
    out = np.zeros(size, np.int64)
    for code, df in counted.collect():  # one row per term of the block
        out[code] = df
    return out


def _best(columns: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of rows ``item, score, h, m, first, members`` the best of each item, in order."""
    order = np.lexsort((columns[2], columns[4], -columns[1], columns[0]))
    item = columns[0][order]
    begin = np.searchsorted(item, item)
    kept = order[np.arange(len(order)) - begin < top]
    return [c[kept] for c in columns]


def scored(classes: DataFrame, asked: list[set[int]], weights: np.ndarray, top: int) -> DataFrame:
    """Per task and item the best classes, as ``BEST``."""
    pairs = sorted((code, k) for k, own in enumerate(asked) for code in own)
    of_term = np.array([k for _, k in pairs], np.int64)
    begins = np.searchsorted(np.array([c for c, _ in pairs], np.int64), np.arange(len(weights) + 1))
    n_items = len(asked)

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """First row and scores (rows x items) of portions that keep to ``CELLS``."""
        row, code, count = _flat(batch.column("bag"))
        m = batch.column("m").to_numpy()[row]
        gain = weights[code] * ((1_000_000_000 * count) // (1000 * count + 20 * m))
        repeats = begins[code + 1] - begins[code]
        load = np.cumsum(np.bincount(row, repeats, batch.num_rows) + n_items)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + CELLS, "right")))
            a, b = np.searchsorted(row, (at, stop))
            times = repeats[a:b]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = of_term[np.repeat(begins[code[a:b]], times) + within]
            out = np.zeros((stop - at) * n_items, np.int64)
            np.add.at(out, np.repeat((row[a:b] - at) * n_items, times) + item, np.repeat(gain[a:b], times))
            yield at, out.reshape(-1, n_items)
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64)] * 6
        least = np.ones(n_items, np.int64)
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("h", "m", "first", "members")]
            for at, found in scores(batch):
                row, item = np.nonzero(found >= least)
                best = [
                    np.concatenate((a, b))
                    for a, b in zip(best, [item, found[row, item], *(c[at + row] for c in columns)], strict=True)
                ]
                best = _best(best, top)
                full = np.flatnonzero(np.bincount(best[0], minlength=n_items) == top)
                least[full] = best[1][np.searchsorted(best[0], full, "right") - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0].astype(np.int32)), *map(pa.array, best[1:])], names=[c.split()[0] for c in BEST.split(", ")]
        )

    return classes.select("bag", "h", "m", "first", "members").mapInArrow(run, BEST)


def best_classes(rows: DataFrame, top: int) -> DataFrame:
    """The best classes of each item, of the tasks' best; first in parts, then of the parts."""
    order = [F.desc("score"), "first", "h"]
    for keys in (["item", F.pmod(F.xxhash64("h"), F.lit(16))], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("place", place).where(F.col("place") <= top).drop("place")
    return rows


def least_members(keyed: DataFrame, wanted: DataFrame, top: int) -> DataFrame:
    """``h, m, first, docs``: the ``top`` least ids of each wanted class (``h, m, first, bag``)."""
    names = ["h", "m", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate((a, b.to_numpy())) for a, b in zip(held, batch.columns, strict=True)]
            order = np.lexsort(held[::-1])
            held = [c[order] for c in held]
            new = np.any([np.diff(c, prepend=c[:1]) != 0 for c in held[:3]], axis=0)
            begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            near = np.arange(len(new)) - begin < top
            held = [c[near] for c in held]
        if len(held[0]):
            edge = np.flatnonzero(np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in held[:3]], axis=0))
            docs = pa.ListArray.from_arrays(pa.array(np.append(edge, len(held[0])).astype(np.int32)), pa.array(held[3]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[edge]) for c in held[:3]), docs], names=[*names, "docs"])

    joined = keyed.join(hinted(wanted, BROADCAST_CLASSES), ["h", "m", "bag"]).select(*names, "doc")
    lists = joined.mapInArrow(run, "h long, m long, first long, docs array<long>")
    merged = lists.groupBy(*names).agg(F.array_sort(F.flatten(F.collect_list("docs"))).alias("docs"))
    return merged.withColumn("docs", F.slice("docs", 1, top))


def _ranked(docs: DataFrame, block: list[tuple], totals: dict, top: int, id_kind: str) -> DataFrame | None:
    spark = docs.sparkSession
    own = terms_of([text for _, text in block])
    codes = {term: k for k, term in enumerate(sorted(set().union(*own)))}
    if not codes:
        return None
    held = stash(bags(docs, codes), "bags")
    if not totals:
        row = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")).first()
        totals.update(documents=row.documents, terms=row.terms or 0)
    if not totals["documents"]:
        return None
    keyed = class_table(held, **totals)
    classes = stash(
        keyed.groupBy("h", "bag", "m").agg(F.count("*").alias("members"), F.min("doc").alias("first")), "classes"
    )
    df = frequencies(classes, len(codes)).tolist()
    weights = [math.floor(1000 * math.log((2 * totals["documents"] + 2) / (2 * f + 1))) for f in df]
    asked = [{codes[t] for t in terms} for terms in own]
    best = stash(best_classes(scored(classes, asked, np.array(weights, np.int64), top), top), "best")
    many = best.where("members > 1").select("h", "m", "first").distinct()
    wanted = stash(classes.join(hinted(many, BROADCAST_CLASSES), ["h", "m", "first"]).select("h", "m", "first", "bag"), "wanted")
    lists = least_members(keyed, wanted, top)
    expanded = best.join(lists, ["h", "m", "first"], "left").select(
        "item", "score", F.explode(F.coalesce("docs", F.array("first"))).alias("doc")
    )
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {id_kind}")
    return (
        expanded.withColumn("rank", rank.cast("int"))
        .where(F.col("rank") <= top)
        .join(F.broadcast(names), "item")  # a block's items
        .select("item_id", "rank", F.nullif("doc", F.lit(LAST)).alias("doc_id"), "score")
    )


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item, equal scores
    by ascending id."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    id_kind, totals = asked.schema["item_id"].dataType.simpleString(), {}
    found = [_ranked(narrow, block, totals, top, id_kind) for block in blocks(asked, block_chars)]
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {id_kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
