"""The operators that run Python in tasks: index, archives, pages, packing, near duplicates."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import rows as R
from pyspark.sql import functions as F

from runlens.llm import decontaminate, neardup, packing, warc, wrapper
from runlens.llm.queries import tokenizer_path

ITEMS = [
    (1, "The QUICK brown fox, jumps over the lazy dog while twelve patient herons"),
    (2, "word"),
    (3, None),
    (4, ""),
    (5, "a-b c d"),
    (6, "w1é w2é w3é w4é w5é w6é w7é w8é w9é w10é w11é"),
    (None, "the old mill and nobody in the village remembers who"),
    (7, "a b c d"),
]


def items(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, n int")


@pytest.mark.parametrize("segment_bytes", [200, 8 << 20])
def test_contamination_equals_brute_force(spark, segment_bytes):
    index = decontaminate.build(R.documents(spark), segment_bytes=segment_bytes)
    for settings in ({}, {"block_chars": 20, "broadcast_terms": 0}):
        got = decontaminate.contamination(index, items(spark), **settings).collect()
        found = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got)
        assert found == sorted((i or 0, *R.contamination(t, ITEMS)) for i, t in R.DOCS)


def test_clean_keeps_the_rest(spark):
    docs = R.documents(spark)
    kept = decontaminate.clean(docs, items(spark))
    want = [i for i, t in R.DOCS if not R.contamination(t, ITEMS)[1]]
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert decontaminate.clean(docs.limit(0), items(spark)).count() == 0
    assert decontaminate.clean(docs, items(spark).limit(0)).count() == docs.count()


def test_phrase_and_proximity_matches(spark):
    rows = [(1, "x alpha beta gamma y gamma beta alpha"), (2, "gamma z alpha z beta"), (3, "alpha beta"), (4, "beta gamma alpha")]
    index = decontaminate.build(R.documents(spark, rows))
    asked = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {(r.doc_id, r.kind, r.start) for r in decontaminate.matches(index, asked, slop=4).collect()}
    assert {x for x in got if x[1] == "phrase"} == {(1, "phrase", 1)}
    words = {i: t.split() for i, t in rows}
    near = {
        (i, "near", s)
        for i, w in words.items()
        for s in range(len(w))
        if w[s] in ("alpha", "beta", "gamma") and {"alpha", "beta", "gamma"} <= set(w[s : s + 4])
    }
    assert {x for x in got if x[1] == "near"} == near


PAGES = [
    (1, "http://b.example.org/x?q#f", "<p>" + "a" * 2000),
    (2, "http://a.example.org/", "<p>" + "a" * 2000),
    (3, "http://a.example.org/", "<p>" + "a" * 2000),
    (4, "http://c.org", "short"),
    (5, "http://c.org", "short"),
    (6, None, None),
    (7, "odd\r\nurl", ""),
    (8, "http://b.example.org/x?q", "é" * 900),
    (8, "http://b.example.org/x?q", "é" * 900),
    (None, "http://d.org/", "<p>" + "a" * 2000),
    (9, "http://D.org/", "long\r\n\r\n" * 50_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(
        [(*r, "x", "x", 0) for r in rows], "page_id long, url string, html string, key string, digest string, host int"
    )


def test_archive_round_trip(spark):
    import hashlib

    archive = warc.write(pages(spark), block_lines=2)
    asked = pages(spark).select("page_id", warc.surt(F.col("url")).alias("k"))
    captures = warc.lookup(archive, asked, key_col="k", id_col="page_id")
    assert captures.count() == len(PAGES)
    every = warc.fetch(archive, spark.createDataFrame(captures.collect(), captures.schema), with_payload=True).collect()
    html = defaultdict(set)
    for i, _, h in PAGES:
        html[i].add(h or "")
    for r in every:
        data = next(iter(html[r.page_id])).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.record_type == ("revisit" if r.page_id in (None, 1, 2) else "response")
        assert r.refers_to == (3 if r.page_id in (None, 1, 2) else None)
        assert r.payload == (data if r.record_type == "response" else None)


def test_lookup_by_key(spark):
    archive = warc.write(pages(spark, [(i, f"http://h{i % 7}.org/p", f"{i}") for i in range(100)]), block_lines=3)
    asked = spark.createDataFrame([("org,h3)/p",), ("org,h9)/p",), (None,), ("",)], "key string")
    assert sorted(r.page_id for r in warc.lookup(archive, asked).collect()) == list(range(3, 100, 7))


def test_empty_archive(spark):
    archive = warc.write(pages(spark, []))
    asked = spark.createDataFrame([("org,h3)/p",)], "key string")
    assert warc.fetch(archive, warc.lookup(archive, asked)).count() == 0


def page(body, n):
    return (
        f"<html><head><title>t{n}</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>m{n}</a></nav>"
        f"<div class='cookie-notice'>We use {n}</div>{body}<aside>s{n}</aside><form>f</form>"
        f"<section id=comments><p>reader {n}</p></section><footer>&copy; {n}</footer></body></html>"
    )


def article(n):
    return f"<article><h1>T {n}</h1><p><b>b&amp;{n}<br><p>x  y\n<i>z</i>{n} {'long text ' * 20}</p><ul><li>one{n}<li>two</ul><p>Read our letter now</p></article>"


def texts(spark, rows):
    found = wrapper.extract(pages(spark, rows))
    return {r.page_id: r.text for r in found.collect()}, found


def test_main_text(spark):
    rows = [(n, f"http://h.org/{n}", page(article(n), n)) for n in range(20)]
    rows += [
        (100, "http://one.org/", page(article(100), 100)),
        (101, None, None),
        (102, "http://h.org/", ""),
        (103, "http://h.org/", page(article(103), 103)[:240]),
        (104, "http://h.org/", "plain &lt;text&gt; &am"),
        (105, "http://h.org/", "<p>cut<a href='x"),
    ]
    got, _ = texts(spark, rows)
    # The same line on nearly all pages of the host is template; on a host's only page it is not.
    long = " " + ("long text " * 20).strip()
    assert got[5] == f"T 5\nb&5\nx y z5{long}\none5"
    assert got[100] == f"T 100\nb&100\nx y z100{long}\none100\ntwo\nRead our letter now"
    assert got[101] == "" and got[102] == "" and got[104] == "plain <text> &am" and got[105] == "cut"
    assert got[103].startswith("T 103")


def test_root_without_article_and_copies(spark):
    body = "<div class=wrap><div class=story-{0}><p>Text of {0}.</p><p>More words {0}</p></div></div>"
    rows = [(n, f"http://h.org/{n}", page(body.format(n), n)) for n in range(12)]
    rows += [(100 + n, f"http://copy.org/{n}", page(article(0), n)) for n in range(12)]
    got, _ = texts(spark, rows)
    assert got[3] == "Text of 3.\nMore words 3"
    assert got[104].startswith("T 0\nb&0")


def test_roles_by_name():
    sign = wrapper.signature
    assert sign("article", ' class="comment"')[1:] == (True, False)
    assert sign("article", ' class="post has-sidebar"')[1:] == (False, True)
    assert sign("div", ' class="content no-ads"')[1:] == (False, False)
    assert sign("div", ' id="sidebar-2"')[1:] == (True, False)
    assert sign("body", ' class="single-post nav-open"')[1:] == (False, False)


def test_tree_matching_and_merge():
    a = ["x", [["a", []], ["b", [["c", []]]], ["d", []]]]
    b = ["x", [["b", [["e", []]]], ["f", []], ["d", []]]]
    assert wrapper.matching(a, b) == (3, [(1, 0), (2, 2)])
    assert wrapper.merge(a, b) == ["x", [["a", []], ["b", [["c", []], ["e", []]]], ["f", []], ["d", []]]]
    assert wrapper.matching(a, ["y", []]) == (0, [])


def test_skeletons_are_merged_in_rounds(spark):
    import json

    rows = [("h", json.dumps(wrapper.tree([f"/html/p{i}", "/html"]))) for i in range(40)]
    one = wrapper.wrappers(spark.createDataFrame(rows, "host string, skeleton string"), fan_in=4).collect()
    assert len(one) == 1 and {c[0] for c in json.loads(one[0].skeleton)[1][0][1]} == {f"p{i}" for i in range(40)}


def test_empty_pages(spark):
    assert wrapper.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_whole(spark, capacity):
    from tokenizers import Tokenizer

    docs = [*R.DOCS, *((200 + i, "alpha beta, " * (i % 9)) for i in range(300)), (None, None), (600, "x <|endoftext|> Y")]
    got = packing.pack(R.documents(spark, docs), tokenizer_path(), capacity=capacity, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), capacity):
            piece = np.array(ids[s : s + capacity], "<u4")
            # Larger pieces may have been cut further.
            want.update((i, s + k, x, len(ids)) for k, x in enumerate(piece.tolist()))
    assert Counter((r.doc_id, r.start + k, x, r.doc_tokens) for r in got for k, x in enumerate(r.ids)) == want
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(R.documents(spark, []), tokenizer_path()).count() == 0


def test_cached_pieces_are_the_tokenizers_own():
    import random

    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    letters = "aAbZé eÉT̈ \t\n'.,;:!?-—“”=<>|̸ 0 9½'S'll'Tdon't日本ΣςİſK\x1c\x00\x7f😀‍$#*&%@_/\\~"
    rng = random.Random(1)
    for _ in range(300):
        docs = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3)]
        ids, bounds = encoder.ids(docs)
        for d, a, b in zip(docs, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(d, add_special_tokens=False).ids, repr(d)


def test_best_subset_is_best():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        bag = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 60)
        sums = {sum(c) for n in range(len(bag) + 1) for c in itertools.combinations(bag, n)}
        chosen = packing.best_subset(dict(Counter(bag)), room)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= Counter(bag)[x] for x, n in chosen.items())


@pytest.mark.parametrize("kind", ["mixed", "long", "one"])
def test_plan_has_little_padding(kind):
    rng = np.random.default_rng(0)
    histogram = {
        "mixed": dict(Counter(np.minimum(2048, rng.geometric(0.003, 50_000)).tolist())) | {700: 30_000},
        "long": dict(Counter(rng.integers(1000, 2048, 20_000).tolist())),
        "one": {1500: 1},
    }[kind]
    plan = packing.make_plan(histogram)
    total = sum(x * n for x, n in histogram.items())
    assert plan.padding <= 0.004 * total + 2048 and plan.n_windows <= 1.004 * total / 2048 + 1


def near_copies():
    """Groups around one original, chains whose ends are not alike, and a passage in many texts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    fresh = lambda n: list(rng.choice(vocabulary, n))
    rows, base, passage = [], fresh(120), fresh(50)

    def changed(words, n):
        words = list(words)
        for p in rng.choice(len(words), n, replace=False):
            words[p] = "z" + str(rng.integers(10**9))
        return words

    for _ in range(60):
        rows.append(changed(base, int(rng.integers(0, 9))))
    rows.append(base)
    chain = fresh(150)
    for _ in range(25):
        rows.append(chain)
        chain = changed(chain, 3)
    for _ in range(60):
        rows.append(fresh(40) + passage + fresh(40))
    for n in (1, 2, 4, 5, 6, 9):
        rows += [fresh(n)] * 3
    rows += [fresh(300) for _ in range(20)]
    texts = [" ".join(w) for w in rows]
    order = rng.permutation(len(texts))
    return [(int(i) + 1000, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("short_list,block", [(16, 512), (2, 8), (1000, 512)])
def test_classes_equal_all_pairs(spark, short_list, block):
    rows = [*R.DOCS, *near_copies()]
    got = neardup.classes(R.documents(spark, rows), short_list=short_list, block=block, broadcast_nodes=block).collect()
    want = Counter(zip((i for i, _ in rows), (len(R.shingles(t)) for _, t in rows), R.classes(rows), strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_keep_leaves_one_of_each_class(spark):
    rows = [*R.DOCS, *near_copies()]
    docs = R.documents(spark, rows)
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns
    want = Counter({i for i in R.classes(rows) if i is not None})
    want[None] = 1
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert neardup.keep(docs.limit(0)).count() == 0


def test_shared_values_bound():
    assert neardup.shared_at_least(1) == 1 and neardup.shared_at_least(4) == 1
    assert 6 <= neardup.shared_at_least(32) <= 12


def test_components_of_long_chains(spark):
    name = lambda i: i.to_bytes(16, "big")
    links = [(name(i), name(i + 1)) for i in range(60)] + [(name(100), name(100 + i)) for i in range(1, 30)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert len(got) == 61 + 30
    assert {bytes(got[name(i)]) for i in range(61)} == {name(0)}
    assert {bytes(got[name(100 + i)]) for i in range(30)} == {name(100)}
    none = spark.createDataFrame([], "a binary, b binary")
    assert neardup.components(none).count() == 0


def test_short_copies_beside_long_pages(spark):
    copy = f"<article><h1>Short story</h1><p>{'told again ' * 45}</p></article>"
    long = "<article><h1>Own {0}</h1><p>{1}</p></article>"
    rows = [(n, f"http://h.org/{n}", page(copy, n)) for n in range(80)]
    rows += [(n, f"http://h.org/{n}", page(long.format(n, f"own{n} text " * 900), n)) for n in range(80, 100)]
    got, _ = texts(spark, rows)
    assert all(got[n].startswith("Short story\ntold again") for n in range(80))
    assert all(got[n].startswith(f"Own {n}\nown{n} text") for n in range(80, 100))


def test_stray_quotes_end_with_their_tag():
    read = lambda html: wrapper.main_text(html, None)
    assert read('<article><p class="a"">Hello</p><p>more</p></article>') == "Hello\nmore"
    assert read("<article><p title=it's>One</p><p>we don't stop</p></article>") == "One\nwe don't stop"
    assert read('<article><p class="a>One</p><p>two</p></article>') == "One\ntwo"
    assert read("<p title='a>b' id = \"c>d\" x=\"y>z\"w>text</p><p>cut<a href='x") == "text\ncut"


def test_names_inside_an_article():
    blocks = [("share-price", "Shares rose"), ("bottom-line", "In short"), ("", "Plain"), ("notice", "Updated today")]
    blocks += [("ad-slot", "Buy now"), ("article-header", "Byline"), ("comments-list", "Reader says")]
    body = "".join(f"<div class='{c}'>{t}</div>" for c, t in blocks) + "<section id=search-results>Found</section>"
    assert wrapper.main_text(f"<article>{body}</article>", None) == "Shares rose\nIn short\nPlain\nByline\nFound"


def test_heading_outside_the_text_and_menus(spark):
    body = "<div class=links><a href=/{0}>more{0}</a> <a href=/x>x</a></div><h1>Title {0}</h1><div class=x><p>Own text {0}</p><p>More {0}</p></div><div>Always here</div>"
    got, _ = texts(spark, [(n, f"http://h.org/{n}", page(body.format(n), n)) for n in range(12)])
    assert all(got[n] == f"Title {n}\nOwn text {n}\nMore {n}" for n in range(12))


@pytest.mark.parametrize("words", [2, 400])
def test_template_beside_articles_of_any_length(spark, words):
    body = "<article><h1>T{0}</h1><p>{1}</p><p>{2}</p></article>"
    rows = [(n, f"http://h.org/{n}", body.format(n, f"own{n} " * words, "our terms hold " * 50)) for n in range(10)]
    got, _ = texts(spark, rows)
    assert all(got[n] == f"T{n}\n" + (f"own{n} " * words).strip() for n in range(10))


def test_class_names_made_up_for_each_page(spark):
    name = lambda n: "".join(chr(97 + (n * p) % 26) for p in (3, 5, 7, 11))
    body = "<div class=css-{1}><p>Text {0}</p></div><div class=foot><p>Same line</p></div>"
    rows = [(n, f"http://h.org/{n}", body.format(n, name(n))) for n in range(150)]
    got, _ = texts(spark, rows)
    assert all(got[n] == f"Text {n}" for n in range(150))
    hosts = spark.createDataFrame([("h", r[2]) for r in rows], "host string, html string")
    (learnt,) = wrapper.induce(hosts, node_share=0.2).collect()
    # Names on few pages stay out of the wrapper.
    assert [c[0] for c in wrapper.load(learnt.wrapper)[1]] == ["div.foot"]


def test_markup_of_any_depth(spark):
    deep = "<html><body>" + "<div>" * 20_000 + "<p>t{0}</p>{1}" + "</div>" * 20_000
    rows = [(n, "http://h.org/", deep.format(n, "<p>u</p><i>v</i>" * n)) for n in range(3)]
    got, _ = texts(spark, rows)
    assert got[0] == "t0" and got[2] == "t2\nu\nv\nu\nv"


def test_matching_equals_the_recurrence():
    import random

    def size(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1], 1):
            for j, y in enumerate(b[1], 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size(x, y))
        return best[-1][-1] + 1

    def grow(depth):
        return [rnd.choice("abc"), [grow(depth - 1) for _ in range(rnd.randrange(5))] if depth else []]

    rnd = random.Random(5)
    for _ in range(300):
        a, b = ["r", grow(3)[1]], ["r", grow(3)[1]]
        assert wrapper.matching(a, b)[0] == size(a, b)
        assert wrapper.load(wrapper.dump(a)) == a
        merged = wrapper.merge(a, b)
        assert len(wrapper.preorder(merged)) == len(wrapper.preorder(a)) + len(wrapper.preorder(b)) - size(a, b)


@pytest.mark.parametrize("shared", [140, 165])
def test_texts_of_one_template_do_not_meet(spark, shared):
    """Below-threshold texts of one template give no lists of rare shingles, however many there are."""
    head = " ".join(f"t{i}" for i in range(shared + 4))
    rows = [(n, head + " " + " ".join(f"o{n}x{i}" for i in range(200 - shared))) for n in range(60)]
    copies = [(1000 + n, rows[n][1] + " more") for n in range(0, 60, 7)]
    got = neardup.classes(R.documents(spark, rows + copies), short_list=4)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 1000 for i, _ in rows + copies}
    values = lambda t: neardup.shingle_sets([t])[0]
    frame = spark.createDataFrame(
        [(bytearray(neardup.node_of(values(t))), bytearray(values(t).tobytes())) for _, t in rows], "node binary, values binary"
    )
    assert neardup.rare_lists(frame.select("node"), frame, 75).count() == 0
