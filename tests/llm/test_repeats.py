"""Repeated passages against a comparison of all windows."""

import random
from collections import Counter

import pytest
import rows as R

from runlens.llm import repeats


def brute(texts, width):
    words = [R.blank_words(t) for t in texts]
    where = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if where[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def check(spark, rows, width):
    got = repeats.repeated(R.documents(spark, rows), width=width).collect()
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], width), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_levels():
    assert repeats.levels(35) == [9, 18, 35]
    assert repeats.levels(8) == [8]
    assert repeats.levels(1) == [1]
    assert repeats.levels(100) == [13, 25, 50, 100]


@pytest.mark.parametrize("width", [35, 20, 5, 1])
def test_rows_that_every_operator_bears(spark, width):
    check(spark, R.DOCS, width)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_of_all_lengths(spark, seed):
    """Passages of 1 to 90 words put together anew, so anchors repeat in different company."""
    draw = random.Random(seed)
    pool = [" ".join(f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 90))) for _ in range(25)]
    pool += ["a " * 60, "a b " * 40, "Same WORDS same words"]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(0, 8)))) for i in range(60)]
    check(spark, rows, 35)


def test_windows_differ_in_one_word_or_case(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [
        (1, " ".join(words)),
        (2, " ".join([*words[:34], "X", *words[34:]])),
        (3, " ".join(words[:35])),
        (4, " ".join(words).upper()),
        (5, "  \t".join(words[20:55])),
    ]
    check(spark, rows, 35)


def test_no_candidates_and_no_rows(spark):
    check(spark, [(1, " ".join(map(str, range(100)))), (2, None), (3, "")], 35)
    assert repeats.repeated(R.documents(spark, []), width=35).count() == 0


def test_ranges_of_hashes():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    twice = repeats.Ranges(np.concatenate((x, x)), repeats.ODD[0])
    a, b = np.array([0, 3, 10]), np.array([50, 40, 11])
    assert (twice.of(a, b) == twice.of(a + 50, b + 50)).all()
    values = rng.integers(0, 4, 200)
    for width in (1, 2, 7, 27):
        got = repeats.least_places(values, width)
        assert got.tolist() == [i + int(values[i : i + width].argmin()) for i in range(201 - width)]
