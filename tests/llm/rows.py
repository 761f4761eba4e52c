"""Rows that every operator has to bear, and brute-force versions of the contracts."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BASE = (
    "The quick brown fox jumps over the lazy dog while twelve patient herons watch the slow river bend "
    "around the old mill and nobody in the village remembers who built it or why it was left to the reeds "
    "and the rain that comes every autumn from the western hills without any warning at all"
)
NEAR = BASE.replace("twelve", "eleven").replace("autumn", "spring")
LINES = "one two three\n\none two three\n \t\none two four"
PII = (
    "Write to Ann.Lee+x@mail-7.example.co.uk or 10.0.255.1, not 10.0.256.1; card 4111 1111 1111 1111 é, "
    "call +1 (555) 555-0100 now. a@b.com.c@d.org 1.2.3.4.5.6.7.8 x_y@q.de"
)
LONG = " ".join(f"w{i % 977}é" for i in range(30_000))

#: (doc_id, text)
DOCS = [
    (1, BASE),
    (2, NEAR),
    (3, BASE),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "Word"),
    (8, LINES),
    (9, PII),
    (10, LONG),
    (10, LONG),
    (11, "a b c d"),
    (12, "a b c d"),
    (None, BASE),
    (13, "###$$$ %%% BUY NOW BUY NOW BUY NOW BUY NOW BUY NOW BUY NOW"),
    (14, "日本語 テキスト \U0001f600 ｘ" + " " + "tail. Released under the MIT License. All rights reserved."),
]
#: The ids and texts again beside columns whose names operators use themselves.
CLASHING = "doc_id long, text string, h long, node string, key string, n int, fail_bits string, m string, marks string"


def documents(spark, rows=None):
    rows = DOCS if rows is None else rows
    return spark.createDataFrame([(i, t, 0, "x", "x", 0, "x", "x", "x") for i, t in rows], CLASHING)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    text = text or ""
    words = blank_words(text)
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    covered = {i + o for v in where.values() if len(v) > 1 for i in v for o in range(3)}
    lines = [x for x in text.split("\n") if blank_words(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [
            m.span()
            for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))
        ],
        "card": [
            m.span()
            for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 16 <= len(digits(m)) <= 19 and _luhn(digits(m))
        ],
        "phone": [
            m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15
        ],
    }
    return ",".join(f"{k}:{s}:{e}" for k, v in found.items() for s, e in v)


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items, width=10):
    windows = defaultdict(set)
    for item, t in items:
        words = index_words(t)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[i : i + width])].add(item)
    words, hit, found = index_words(text), set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            own = windows.get(tuple(words[i : i + n]))
            if own:
                hit.update(range(i, i + n))
                found |= own
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def shingles(text):
    words = blank_words((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    """Class id of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) if sets[k] else rows[k][0] for k in range(len(rows))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
