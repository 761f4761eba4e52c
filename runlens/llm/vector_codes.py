"""Product codes of vectors, from integer distances that are exact.

Components become whole numbers, vectors are cut into parts, and each part position has a
codebook that is moved by a few rounds of nearest-entry assignment and floored means. All
distances of a batch come from one matrix product of float64, the fast kind, and still are
exact: the integers are broken into limbs so narrow that no dot product of limbs reaches
2**53, the products of limb pairs are put together in int64, and the first least distance
wins. How many limbs that takes is read from the numbers: one for most embeddings.

The driver holds the codebooks (``entries`` x components) and nothing that grows with the
rows; a task sends at most one number per component of the codebooks in a round.

Defined cases: vectors that are null or hold a null or a component that is not finite are
dropped; so are those of another length than the vector with the least id. Null ids come
after all others; rows with equal ids are ordered by their components; labels may be null;
with fewer rows than ``entries`` the codebooks are shorter; if the length is no multiple of
``parts``, the first parts have a component more; an empty table gives no rows. Components
so large that a squared distance could leave 64 bits end the job with a ``ValueError``.
Only id, vector and label are read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import hinted, stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 4
#: Two hexadecimal digits name an entry.
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows whose distances are held at once.
ROWS_AT_ONCE = 4096
BROADCAST_LABELS = 200_000


def limb_bits(length: int) -> int:
    """The widest limbs of which ``length`` products add up to less than 2**53."""
    return (53 - max(1, length).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 limbs, the lowest first: all but the highest in ``[0, 2**bits)``,
    the highest in ``[-2**bits, 2**bits)``."""
    out, rest = [], values
    while rest.size and (rest.min() < -(1 << bits) or rest.max() >= 1 << bits):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def exact_dots(x: np.ndarray, y: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, right to the last digit wherever it fits int64."""
    bits = limb_bits(x.shape[1]) if bits is None else bits
    out = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest entry, the first one on ties, and the squared distance."""
    most = max((int(np.abs(m).max()) for m in (x, book) if m.size), default=0)
    if 4 * x.shape[1] * most * most >= 1 << 63:
        raise ValueError(f"components up to {most} are too large for 64-bit squared distances")
    partial = (book * book).sum(axis=1) - 2 * exact_dots(x, book)
    best = partial.argmin(axis=1)
    return best, partial[np.arange(len(x)), best] + (x * x).sum(axis=1)


@dataclass(frozen=True)
class Codebooks:
    """Per part its entries, one row each."""

    books: tuple[np.ndarray, ...]

    @property
    def length(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        numbers = (str(v) for book in self.books for v in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def integer_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id, label, v`` of the usable vectors, ``v`` as whole numbers; written once."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(v.isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"),
    )
    whole = stash(kept, "vectors")
    least = whole.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).first()
    return whole.where(F.size("v") == (least[0] if least else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def _cut(matrix: np.ndarray, books: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    return np.split(matrix, np.cumsum([b.shape[1] for b in books])[:-1], axis=1)


def _cells(whole: DataFrame, books: tuple[np.ndarray, ...]) -> np.ndarray:
    """Counts and component sums of the rows next to each entry, as one vector in the order
    counts of part 0, sums of part 0, counts of part 1 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.zeros((len(b), 1 + b.shape[1]), np.int64) for b in books]
        for batch in _portions(batches):
            for part, x in enumerate(_cut(_matrix(batch.column(0)), books)):
                best, _ = nearest(x, books[part])
                np.add.at(cells[part], best, np.column_stack((np.ones(len(x), np.int64), x)))
        flat = np.concatenate([c.ravel() for c in cells])
        there = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(flat[there])], names=["cell", "n"])

    sums = whole.select("v").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(sum(b.shape[0] * (1 + b.shape[1]) for b in books), np.int64)
    for cell, n in sums.collect():  # one row per number of the codebooks
        out[cell] = n
    return out


def train(
    whole: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks from ``integer_vectors``: the parts of the ``entries`` least ids, moved
    ``rounds`` times to the floored mean of the rows next to them. None without rows."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"entries must be 1 to {ENTRIES}")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not first:
        return None
    start = np.array([r.v for r in first], np.int64)
    books = tuple(np.array_split(start, parts, axis=1))
    for _ in range(rounds):
        cells, at, moved = _cells(whole, books), 0, []
        for book in books:
            size = book.shape[0] * (1 + book.shape[1])
            own = cells[at : at + size].reshape(book.shape[0], -1)
            at += size
            n = own[:, :1]
            moved.append(np.where(n > 0, own[:, 1:] // np.maximum(n, 1), book))
        books = tuple(moved)
    return Codebooks(books)


def encode(whole: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``vec_id, label, code, error``: per part the number of the nearest entry in two
    hexadecimal digits, and the sum of the squared distances."""
    books = codebooks.books
    width = 2 * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            found = [nearest(x, book) for x, book in zip(_cut(_matrix(batch.column(2)), books), books, strict=True)]
            digits = np.column_stack([best for best, _ in found]).astype(np.uint8).tobytes().hex().encode()
            offsets = np.arange(0, len(digits) + 1, width, dtype=np.int32)
            code = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(offsets), pa.py_buffer(digits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), code, pa.array(sum(e for _, e in found))],
                names=["vec_id", "label", "code", "error"],
            )

    label = whole.schema["label"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def codes(vectors: DataFrame, **columns: str) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of all usable vectors.

    ``label_error`` adds up the errors of equal labels, null labels together. The sums are
    one row per label; few of them are broadcast, many joined by a shuffle of plain tables,
    in which the rows of a hot label are split."""
    whole = integer_vectors(vectors, **columns)
    codebooks = train(whole)
    if codebooks is None:
        label = whole.schema["label"].dataType.simpleString()
        kind = f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], kind)
    coded = stash(encode(whole, codebooks), "codes")
    sums = stash(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = coded.join(hinted(sums, BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(
        "vec_id", "label", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256")
    )
