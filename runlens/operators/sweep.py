"""The sweep over one partition of blocks: the only Python code run inside tasks.

It is shipped to the tasks by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from runlens.operators.baseline import BATCH_UPPER_RANK
from runlens.operators.profile import MEASURES

# Quantiles kept by the sweep: (output column, measure, rank).
SLICES = (
    ("p50_duration", "duration_seconds", 0.5),
    ("p95_duration", "duration_seconds", BATCH_UPPER_RANK),
    ("p50_app_vcore_seconds", "app_vcore_seconds", 0.5),
    ("p95_app_vcore_seconds", "app_vcore_seconds", BATCH_UPPER_RANK),
    ("p50_app_memory_gb_seconds", "app_memory_gb_seconds", 0.5),
    ("p95_app_memory_gb_seconds", "app_memory_gb_seconds", BATCH_UPPER_RANK),
    ("p95_task_duration_ms", "p95_task_duration_ms", BATCH_UPPER_RANK),
)
AVERAGES = (
    ("avg_duration", "duration_seconds"),
    ("avg_app_vcore_seconds", "app_vcore_seconds"),
    ("avg_app_memory_gb_seconds", "app_memory_gb_seconds"),
    ("avg_max_over_median_ratio", "max_over_median_ratio"),
)

# Kinds of rows, in the order a block delivers them.
SUMMARY, BUCKET, RUN = 0, 1, 2
CHUNK_ROWS = 32_768
_NO_COUNTS, _NO_SUMS = [0] * len(MEASURES), [0.0] * len(MEASURES)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class OrderStatistics:
    """The k-th smallest of any slice of a sequence, for many slices at once.

    A wavelet matrix over the ranks of the values: one level per bit, each with the running
    number of zero bits. A query goes down the levels; all queries take a level together.
    """

    def __init__(self, values: np.ndarray):
        self.sorted, codes = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in range(max(1, int(len(self.sorted) - 1).bit_length()) - 1, -1, -1):
            ones = (codes >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - ones)))
            self.levels.append((bit, zeros))
            codes = np.concatenate((codes[ones == 0], codes[ones == 1]))

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th (from 0) smallest of ``values[low:high]``."""
        code = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            below, upto = zeros[low], zeros[high]
            count = upto - below
            one = k >= count
            low = np.where(one, zeros[-1] + low - below, below)
            high = np.where(one, zeros[-1] + high - upto, upto)
            k = np.where(one, k - count, k)
            code |= one.astype(np.int64) << bit
        return self.sorted[code]


class _Block:
    """The rows of one block, with what it was told of earlier blocks."""

    __slots__ = ("job_id", "samples", "cluster", "counts", "sums", "hidden", "held", "uids", "clusters", "parts")

    def __init__(self, job_id: str):
        self.job_id = job_id
        self.samples, self.cluster = 0, None
        self.counts, self.sums = _NO_COUNTS, _NO_SUMS
        # Per quantile: how many smaller values are not held, and the values in reach.
        self.hidden: dict[int, float] = {}
        self.held: dict[int, list[np.ndarray]] = {}
        self.uids: list[str] = []
        self.clusters: list[str] = []
        self.parts: list[np.ndarray] = []

    def note(self, kind: int, numbers: np.ndarray, cluster: str | None) -> None:
        n = len(MEASURES)
        if kind == SUMMARY:
            self.samples, self.cluster = int(numbers[0]), cluster
            self.counts, self.sums = numbers[1 : n + 1].tolist(), numbers[n + 1 :].tolist()
        else:
            i = int(numbers[0])
            self.hidden[i] = min(self.hidden.get(i, float("inf")), float(numbers[1]))
            self.held.setdefault(i, []).append(numbers[2:])


def _sums(blocks: list[_Block]) -> np.ndarray:
    """Per row the sums of its block before it, each block summed from its own start."""
    out = []
    for b in blocks:
        own = np.vstack((b.sums, *b.parts))[:-1]
        out.append(np.cumsum(np.where(np.isnan(own), 0.0, own), axis=0))
    return np.concatenate(out)


def _quantile(i: int, blocks: list[_Block], of: np.ndarray, own: np.ndarray, seen: np.ndarray, first: np.ndarray):
    """The i-th running quantile at every row. ``of`` is the row's block, ``own`` the rows'
    values, ``seen`` the values before a row, ``first`` those before its block."""
    _, measure, rank = SLICES[i]
    m = MEASURES.index(measure)
    held = [b.held.get(i, ()) for b in blocks]
    sizes = np.fromiter((sum(map(len, h)) for h in held), np.int64, len(held))
    upto = np.cumsum(sizes)
    # Each block's values in reach stand before its own.
    values = own[~np.isnan(own)]
    if upto[-1]:
        values = np.insert(values, np.repeat(first, sizes), np.concatenate([a for h in held for a in h]))
    low, high = (first + upto - sizes)[of], seen + upto[of]
    count = np.array([b.counts[m] for b in blocks], np.int64)[of] + seen - first[of]
    hidden = np.array([b.hidden.get(i, 0) for b in blocks]).astype(np.int64)[of]
    out = np.full(len(of), np.nan)
    some = count > 0
    if some.any():
        position = (count[some] - 1) * rank
        floor = np.floor(position)
        order = OrderStatistics(values)
        near = [
            order.smallest(low[some], high[some], k.astype(np.int64) - hidden[some])
            for k in (floor, np.ceil(position))
        ]
        out[some] = near[0] + (near[1] - near[0]) * (position - floor)
    return out


def _baselines(blocks: list[_Block], names: list[str]) -> pa.RecordBatch:
    """Baseline rows of whole blocks, for the rows that have an earlier sample."""
    rows = np.array([len(b.uids) for b in blocks])
    of, start = np.repeat(np.arange(len(blocks)), rows), np.cumsum(rows) - rows
    values = np.concatenate([p for b in blocks for p in b.parts])
    there = ~np.isnan(values)
    seen = np.cumsum(there, axis=0) - there
    first = seen[start]
    some = there.any(axis=1)
    samples = np.cumsum(some) - some
    before = np.array([b.samples for b in blocks])[of] + samples - samples[start][of]
    newest = np.maximum.accumulate(np.where(some, np.arange(len(some)), -1))
    newest = np.concatenate(([-1], newest[:-1]))
    own_clusters = [c for b in blocks for c in b.clusters]
    told = [b.cluster for b in blocks]
    clusters = [
        own_clusters[k] if inside else told[j]
        for k, inside, j in zip(newest.tolist(), (newest >= start[of]).tolist(), of.tolist(), strict=True)
    ]
    keep = pa.array(before > 0)

    def kept(column, kind: pa.DataType) -> pa.Array:
        return pa.array(column, kind, from_pandas=True).filter(keep)

    columns = [
        kept([u for b in blocks for u in b.uids], pa.string()),
        kept([b.job_id for b in blocks for _ in b.uids], pa.string()),
        kept(clusters, pa.string()),
        kept(before, pa.int64()),
    ]
    for i, (_, measure, _) in enumerate(SLICES):
        m = MEASURES.index(measure)
        columns.append(kept(_quantile(i, blocks, of, values[:, m], seen[:, m], first[:, m]), pa.float64()))
    sums = _sums(blocks)
    for _, measure in AVERAGES:
        m = MEASURES.index(measure)
        n = np.array([b.counts[m] for b in blocks], float)[of] + seen[:, m] - first[:, m][of]
        columns.append(kept(np.divide(sums[:, m], n, out=np.full(len(n), np.nan), where=n > 0), pa.float64()))
    return pa.RecordBatch.from_arrays(columns, names=names)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running baselines of a partition whose rows come by block, notes first. Blocks are
    gathered to about ``CHUNK_ROWS`` rows, because NumPy calls cost the same for few rows."""
    names = ["uid", "job_id", "cluster_name", "run_count"]
    names += [name for name, _, _ in SLICES] + [name for name, _ in AVERAGES]
    blocks: list[_Block] = []
    current, held = None, 0
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        kinds = col["kind"].to_numpy(zero_copy_only=False)
        jobs, numbers = col["job_id"].to_pylist(), col["block"].to_pylist()
        uids, clusters = col["uid"].to_pylist(), col["cluster_name"].to_pylist()
        values = np.column_stack([col[m].to_numpy(zero_copy_only=False).astype(float) for m in MEASURES])
        notes = col["numbers"]
        told, ends = notes.values.to_numpy(zero_copy_only=False).astype(float), notes.offsets.to_numpy()
        at = 0
        while at < len(jobs):
            key = (jobs[at], numbers[at])
            if key != current:
                if held >= CHUNK_ROWS:
                    yield _baselines(blocks, names)
                    blocks, held = [], 0
                current = key
                blocks.append(_Block(jobs[at]))
            if kinds[at] != RUN:
                blocks[-1].note(int(kinds[at]), told[ends[at] : ends[at + 1]], clusters[at])
                at += 1
                continue
            end = at + 1
            while end < len(jobs) and (jobs[end], numbers[end]) == key:
                end += 1
            blocks[-1].uids += uids[at:end]
            blocks[-1].clusters += clusters[at:end]
            blocks[-1].parts.append(values[at:end])
            held += end - at
            at = end
    if blocks:
        yield _baselines(blocks, names)
