"""Ranked search against scores of every document, one by one."""

import math
import re
from collections import Counter

import pytest
import rows as R

from runlens.llm import ranked

ITEMS = [
    (1, "The quick BROWN fox, the lazy dog"),
    (2, "village"),
    (3, None),
    (4, ""),
    (5, "a-b c d"),
    (6, "w1é w2é w3é zzz"),
    (None, "autumn hills"),
    (7, "nowhere to be seen1"),
    (2, "river mill"),
    (8, "日本語 テキスト"),
]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(R.LOWER))


def brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    some = [c for _, c in counts if c]
    n_docs, n_terms = len(some), sum(sum(c.values()) for c in some)
    df = Counter(t for c in some for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text))
                if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(found[:top])]
    return out


def asked(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, bag string")


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("top,block_chars", [(50, 1 << 20), (3, 1 << 20), (2, 30)])
def test_equals_brute_force(spark, top, block_chars):
    got = ranked.search(R.documents(spark), asked(spark), top=top, block_chars=block_chars)
    same(got.collect(), brute(R.DOCS, ITEMS, top))


def test_classes_of_copies_share_their_places(spark):
    """Many copies, ties between different classes, and classes larger than the report."""
    docs = [(1000 - i, ("alpha beta", "beta alpha", "alpha gamma", "gamma alpha x")[i % 4]) for i in range(200)]
    docs += [(None, "alpha beta"), (5, "alpha alpha beta"), (5, "alpha beta")]
    items = [(1, "alpha"), (2, "alpha beta"), (3, "gamma delta")]
    frame = R.documents(spark, docs).repartition(5)
    same(ranked.search(frame, asked(spark, items), top=50).collect(), brute(docs, items, 50))


def test_small_portions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranked, "CELLS", 7)
    monkeypatch.setattr(ranked, "BATCH_BYTES", 100)
    got = ranked.search(R.documents(spark), asked(spark), top=5)
    same(got.collect(), brute(R.DOCS, ITEMS, 5))


def test_empty_tables(spark):
    assert ranked.search(R.documents(spark, []), asked(spark)).count() == 0
    assert ranked.search(R.documents(spark), asked(spark, [])).count() == 0
    nothing = ranked.search(R.documents(spark, [(1, None), (2, "")]), asked(spark))
    assert nothing.columns == ["item_id", "rank", "doc_id", "score"] and nothing.count() == 0
