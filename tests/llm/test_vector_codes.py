"""Vector codes against plain Python integers."""

import hashlib
import random

import numpy as np
import pytest

from runlens.llm import vector_codes as V

NAN, INF = float("nan"), float("inf")


def brute(rows, entries=256, rounds=4, parts=4):
    def floor(x):
        n = int(1024 * x)
        return n - (n > 1024 * x)

    kept = [
        (i, label, [floor(x) for x in v])
        for i, v, label in rows
        if v is not None and all(x is not None and abs(x) < INF for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    cut = lambda v: [p.tolist() for p in np.array_split(np.array(v, object), parts)]
    split = [cut(v) for _, _, v in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def near(u, book):
        return min((sum((a - b) ** 2 for a, b in zip(u, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [near(s[p], books[p])[1] for s in split]
            for e in range(len(books[p])):
                own = [s[p] for s, f in zip(split, found, strict=True) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for (i, label, _), s in zip(kept, split, strict=True):
        best = [near(u, b) for u, b in zip(s, books, strict=True)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(*r, sums[r[1]], digest) for r in out]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n int, v string"
    )


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def vectors(seed, n, length, size):
    draw = random.Random(seed)
    centres = [[draw.uniform(-size, size) for _ in range(length)] for _ in range(7)]
    return [(i, [x + draw.gauss(0, size / 9) for x in draw.choice(centres)], draw.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("length,size", [(8, 1.0), (6, 1.0), (3, 0.01), (8, 100_000.0)])
def test_equals_brute_force(spark, length, size):
    """The largest values take two limbs each."""
    rows = vectors(length, 400, length, size)
    rows += [(None, rows[0][1], 1), (3, rows[3][1], 1), (3, rows[4][1], None)]
    rows += [(900, None, 1), (901, [1.0, None] * 3, 1), (902, [NAN] * length, 0), (903, [INF] * length, 0)]
    rows += [(904, [0.5], 1), (905, [], None)]
    random.Random(1).shuffle(rows)
    same(V.codes(frame(spark, rows).repartition(3)).collect(), brute(rows))


def test_ties_go_to_the_first_entry_and_unused_entries_stay(spark):
    rows = [(i, [float(i % 3)] * 4, i % 2) for i in range(300)]
    same(V.codes(frame(spark, rows)).collect(), brute(rows))


def test_few_rows_and_none(spark):
    rows = [(5, [0.25, -0.25, 1e-9, -1e-9], None)]
    same(V.codes(frame(spark, rows)).collect(), brute(rows))
    same(V.codes(frame(spark, [(1, [], 1), (2, [], 1)])).collect(), brute([(1, [], 1), (2, [], 1)]))
    empty = V.codes(frame(spark, []))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_values_beyond_64_bits_are_refused(spark):
    rows = [(1, [1e7] * 8, 1), (2, [-1e7] * 8, 1)]
    with pytest.raises(Exception, match="too large"):
        V.codes(frame(spark, rows)).collect()


@pytest.mark.parametrize("most", [1, 1023, 1 << 24, 1 << 27])
@pytest.mark.parametrize("bits", [None, 1, 5, 11])
def test_products_are_exact(most, bits):
    rng = np.random.default_rng(most)
    x, y = rng.integers(-most, most + 1, (40, 16)), rng.integers(-most, most + 1, (9, 16))
    x[0], y[0] = most, -most
    assert (V.exact_dots(x, y, bits) == x.astype(object) @ y.astype(object).T).all()


def test_limbs_keep_products_below_the_mantissa():
    for length in (1, 2, 16, 1024, 12345):
        bits = V.limb_bits(length)
        assert length << (2 * bits) < 1 << 53
