"""Main text of web pages by wrapper induction.

Each page's DOM is reduced to its skeleton: the tree of element signatures, with equal
siblings merged. Skeletons of one host are aligned by simple tree matching and merged into
the host's wrapper. Every page is then aligned with its host's wrapper, and statistics are
kept by wrapper node: a text that stands in the same node with nearly all contents is
constant and becomes template; a node whose text is mostly links is a menu; all other slots
vary and are content, in page order, unless their role is known (menus, headers, footers,
sidebars, notices, adverts, forms, comments). Where marked articles hold most of a host's
varying text, a page gives its article alone; inside one, names count as a role only if the
whole name speaks of it (``share`` and ``share-buttons``, not ``share-price``).

Pages with the same article are one content, so copies of an article give no evidence that
its text is template; neither does a text seen with fewer than ``min_pages`` contents.

Statistics are partial aggregates over single rows, so a host with a third of all pages
is as good as any other. Nodes on less than ``NODE_SHARE`` of a host's pages cannot be
template and stay out of its wrapper, which bounds it by 1 / ``NODE_SHARE`` average pages,
whatever class names a site makes up; skeletons meet in groups of bounded size that are
merged in rounds. All work on trees is iterative, so markup may be nested at any depth.

Defined cases: a null or empty html gives an empty text; unclosed and cut markup is read as
browsers do, a tag cut at the end is dropped; hosts without evidence and nodes outside the
wrapper are read by roles alone; a page of which nothing but headings varies is a copy, and
nothing is taken from it; near copies (not equal ones) that make up most of a host's
contents do pass for template where they agree; repeated rows are answered each; an empty
table gives no rows; only id, URL and html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import stash
from runlens.llm.url_filter import host

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_PAGES = 8
CONSTANT_SHARE = 0.8
NODE_SHARE = 0.01
FAN_IN = 256
BROADCAST_BYTES = 32 << 20

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag closes an open element of these names, unless one of the bounds comes first.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

#: Elements and name parts whose role is never the article.
BOILER_TAGS = frozenset(
    "head nav footer aside form menu dialog noscript button select option datalist fieldset canvas audio video "
    "object search".split()
)
BOILER_NAMES = frozenset(
    "nav navbar navigation menu header masthead topbar footer bottom sidebar aside ad ads advert adverts advertisement "
    "adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay comment comments disqus respond reply replies share sharing social related recommended newsletter "
    "subscribe signup login search breadcrumb breadcrumbs pagination pager widget toolbar skip copyright".split()
)
REPLY_NAMES = frozenset("comment comments reply replies advert advertisement sponsored related recommended".split())
#: Words beside which a role word still makes up the whole name, and role words that inside an
#: article more often name a part of it.
PLAIN_NAMES = frozenset(
    "area article articles bar block body box button buttons col column container content form group icon icons inner "
    "item items left link links list main media outer page panel post posts right row section site slot stories story "
    "text unit wrap wrapper".split()
)
PART_NAMES = frozenset("header masthead topbar bottom overlay skip copyright toolbar".split())
BESIDE = frozenset("has no with without".split())
ROOT_NAMES = frozenset("article articlebody post entry story".split())

# Quotes delimit a value only right after "="; one that is never closed is read as a plain character.
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|[\"'][^\s>]*+)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)"
    rf"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
TREE_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]]')
HEADING = re.compile("h[1-6](?![a-z0-9])")
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


# What was worked out before, in this process. Plain dicts travel to the tasks with their
# functions, which need no copy of the package there.
_ROLES: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}
_RULES: dict[str | None, tuple] = {}
_TREES: dict[str, list] = {}


def _cached(cache: dict, most: int, key, make):
    if key not in cache:
        if len(cache) >= most:
            cache.clear()
        cache[key] = make(key)
    return cache[key]


def signature(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's name in a skeleton; whether its role is boilerplate; whether it is an article."""
    return roles(tag, attributes)[:3]


def roles(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """``signature``, and whether the element is boilerplate even inside an article."""
    return _cached(_ROLES, 20_000, (tag, attributes), lambda key: _roles(*key))


def _roles(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    # Parts of a name with digits number things, or are made up; they would tell pages of one template apart.
    kept = ("-".join(x for x in c.split("-") if not re.search("[0-9]", x)) for c in found.get("class", "").lower().split())
    sign = tag + "".join(f".{c}" for c in sorted(set(kept) - {""})[:3])
    role = found.get("role", "").lower()
    parts = [[w for w in re.split(r"[^a-z]+", n) if w] for n in names.split()]
    # Names such as has-sidebar say what stands beside the element.
    parts = [p for p in parts if not BESIDE.intersection(p)]
    words = {w for p in parts for w in p}
    article = tag in ("article", "main") or role in ("main", "article") or tag not in ("html", "body") and bool(
        words & ROOT_NAMES or found.get("itemprop", "").lower() == "articlebody"
    )
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(
        r"display\s*:\s*none", found.get("style", "")
    )
    listed = role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
    outside = REPLY_NAMES if tag in ("article", "main", "h1") else BOILER_NAMES
    # The header of an entry is a part of it.
    outside = outside - PART_NAMES if words & ROOT_NAMES else outside
    inside = outside - PART_NAMES
    plain = tag not in ("html", "body")
    always = tag in BOILER_TAGS or bool(hidden) or listed
    boiler = always or plain and bool(words & outside)
    whole = plain and any(inside.intersection(p) and inside.union(PLAIN_NAMES).issuperset(p) for p in parts)
    return sign.replace("/", "_"), boiler, article and not boiler, always or whole


class Block(NamedTuple):
    node: int
    text: str
    links: int  # characters inside links
    boiler: bool
    rooted: bool  # inside an article
    heading: bool


class Page:
    """Blocks in page order, and the skeleton: ``nodes`` holds ``[signature, children]`` by number."""

    def __init__(self, html: str | None):
        self.blocks: list[Block] = []
        self.nodes: list[list] = [["", []]]
        self._numbers: dict[tuple[int, str], int] = {}
        if html:
            self._read(html)

    @property
    def tree(self) -> list:
        return self.nodes[0]

    def _child(self, node: int, sign: str) -> int:
        number = self._numbers.setdefault((node, sign), len(self.nodes))
        if number == len(self.nodes):
            self.nodes.append([sign, []])
            self.nodes[node][1].append(self.nodes[number])
        return number

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = []  # tag, node, boiler, inside an article
        opened: dict[str, int] = {}  # elements of the stack by tag
        node, boiler, article, texts, links, in_link = 0, False, False, [], 0, 0

        def flush() -> None:
            nonlocal links
            if texts:
                text = "".join(texts)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                if text:
                    heading = bool(HEADING.match(self.nodes[node][0]))
                    self.blocks.append(Block(node, text, links, boiler, article, heading))
                texts.clear()
            links = 0

        def cut(depth: int) -> None:
            """Close all elements from this depth on."""
            nonlocal node, boiler, article, in_link
            if any(x[0] not in INLINE for x in stack[depth:]):
                flush()
            for x in stack[depth:]:
                opened[x[0]] -= 1
            in_link = opened.get("a", 0)
            del stack[depth:]
            _, node, boiler, article = stack[-1] if stack else ("", 0, False, False)

        at, token = 0, TOKEN.search
        while True:
            m = token(html, at)
            end = m.start() if m else len(html)
            if end > at:
                piece = html[at:end]
                texts.append(piece)
                if in_link:
                    links += len(piece)
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None or m[4] != ">":
                continue
            tag = tag.lower()
            if m[1]:
                for k in () if not opened.get(tag) else range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        cut(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
                continue
            if tag == "br":
                texts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else len(html)
                texts.append(" ")
                continue
            if tag in ENDS_P and opened.get("p"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        cut(k)
                        break
                    if stack[k][0] in ("td", "th", "button", "table"):
                        break
            if tag in ENDS:
                own, bounds = ENDS[tag]
                for k in () if not any(opened.get(x) for x in own) else range(len(stack) - 1, -1, -1):
                    if stack[k][0] in own:
                        cut(k)
                        if tag != "tr":
                            break
                    elif stack[k][0] in bounds:
                        break
            if tag not in INLINE:
                flush()
            sign, outside, main, inside = roles(tag, m[3])
            odd = inside if article else outside or tag == "header"
            if tag in INLINE:
                if odd and not boiler:
                    flush()
            else:
                node = self._child(node, sign)
                article = article or main
            boiler = boiler or odd
            stack.append((tag, node, boiler, article))
            opened[tag] = opened.get(tag, 0) + 1
            in_link = opened.get("a", 0)
        flush()


def tree(paths: list[str]) -> list:
    """``[signature, children]`` of the paths, in their order."""
    root: list = ["", []]
    for path in paths:
        node = root
        for sign in path.split("/")[1:]:
            child = next((c for c in node[1] if c[0] == sign), None)
            if child is None:
                child = [sign, []]
                node[1].append(child)
            node = child
    return root


def dump(root: list) -> str:
    """The tree as JSON. The encoder of the library would not go as deep as markup does."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append(f"[{json.dumps(x[0])}, [")
            todo.append("]]")
            for k, child in enumerate(reversed(x[1])):
                if k:
                    todo.append(", ")
                todo.append(child)
    return "".join(out)


def load(text: str) -> list:
    """The tree of ``dump``."""
    root: list = []
    todo = [root]
    for token in TREE_TOKEN.findall(text):
        if token == "[":
            todo.append([])
        elif token == "]":
            done = todo.pop()
            todo[-1].append(done)
        else:
            todo[-1].append(json.loads(token))
    return root[0]


def preorder(root: list) -> list[list]:
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        found.append(x)
        todo += reversed(x[1])
    return found


def _heaviest(pairs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Of ``(i, j, weight)`` the heaviest sequence in which both ``i`` and ``j`` rise."""
    if len(pairs) == 1:
        return pairs[0][2], [pairs[0][:2]]
    places = {j: k for k, j in enumerate(sorted({j for _, j, _ in pairs}), 1)}
    best: list[tuple[int, tuple | None]] = [(0, None)] * (len(places) + 1)  # greatest sums of prefixes of j
    # Of one i the greater j come first, so that none follows another.
    for i, j, weight in sorted(pairs, key=lambda p: (p[0], -p[1])):
        k, chain = places[j] - 1, (0, None)
        while k:
            chain, k = max(chain, best[k], key=lambda c: c[0]), k & (k - 1)
        chain, k = (chain[0] + weight, (i, j, chain[1])), places[j]
        while k < len(best):
            best[k], k = max(best[k], chain, key=lambda c: c[0]), k + (k & -k)
    total, link = max(best, key=lambda c: c[0])
    found = []
    while link:
        found.append(link[:2])
        link = link[2]
    return total, found[::-1]


def alignment(a: list, b: list) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching of two trees with equal roots: by the ``id`` of two nodes that may be matched,
    the size of their largest matching and the pairs of children in it. Children whose
    signatures differ weigh nothing, so only equal ones are looked at."""
    found: dict = {}
    todo = [(a, b, None)]
    while todo:
        x, y, pairs = todo.pop()
        if pairs is None:
            places: dict[str, list[int]] = {}
            for j, child in enumerate(y[1]):
                places.setdefault(child[0], []).append(j)
            pairs = [(i, j) for i, child in enumerate(x[1]) for j in places.get(child[0], ())]
            todo.append((x, y, pairs))
            todo += [(x[1][i], y[1][j], None) for i, j in pairs]
        elif pairs:
            size, chosen = _heaviest([(i, j, found[id(x[1][i]), id(y[1][j])][0]) for i, j in pairs])
            found[id(x), id(y)] = size + 1, chosen
        else:
            found[id(x), id(y)] = 1, []
    return found


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest matching, and the pairs of children in it."""
    return alignment(a, b)[id(a), id(b)] if a[0] == b[0] else (0, [])


def merge(a: list, b: list) -> list:
    """``a`` with the nodes of ``b`` that it does not align with, at their places."""
    aligned = alignment(a, b)
    root: list = [a[0], []]
    todo = [(a, b, root)]
    while todo:
        x, y, out = todo.pop()
        i = j = 0
        for k, m in [*aligned[id(x), id(y)][1], (len(x[1]), len(y[1]))]:
            out[1] += x[1][i:k] + y[1][j:m]
            if k < len(x[1]):
                child = [x[1][k][0], []]
                out[1].append(child)
                todo.append((x[1][k], y[1][m], child))
            i, j = k + 1, m + 1
    return root


def places(page: list, wrapper: list) -> dict[int, int]:
    """By the ``id`` of a page's node, the number of the wrapper node that it is aligned with."""
    numbers = dict(zip(map(id, preorder(wrapper)), count()))
    aligned = alignment(page, wrapper)
    found, todo = {}, [(page, wrapper)]
    while todo:
        x, y = todo.pop()
        found[id(x)] = numbers[id(y)]
        todo += [(x[1][i], y[1][j]) for i, j in aligned[id(x), id(y)][1]]
    return found


def marks(root: list) -> dict[int, int]:
    """By the ``id`` of a node, a checksum of the signatures on its path."""
    found, todo = {}, [(root, 0)]
    while todo:
        x, above = todo.pop()
        found[id(x)] = mark = zlib.crc32(f"/{x[0]}".encode(), above)
        todo += [(c, mark) for c in x[1]]
    return found


def pruned(root: list, kept: set[int]) -> list:
    """The tree without nodes whose path is not among ``kept``, and what is below them."""
    mark = marks(root)
    out: list = [root[0], []]
    todo = [(root, out)]
    while todo:
        x, y = todo.pop()
        for c in x[1]:
            if mark[id(c)] in kept:
                y[1].append([c[0], []])
                todo.append((c, y[1][-1]))
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


SURVEY = (
    "host string, skeleton string, paths array<long>, content long,"
    " blocks array<struct<node:int,hash:long,chars:long,links:long,rooted:boolean>>"
)


def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeleton, paths, blocks outside known roles and a checksum of the content of each page."""
    block = pa.struct(
        [("node", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("rooted", pa.bool_())]
    )
    for batch in batches:
        skeletons, paths, contents, blocks = [], [], [], []
        for html in batch.column("html").to_pylist():
            page = Page(html)
            order = dict(zip(map(id, preorder(page.tree)), count()))
            found = {
                (order[id(page.nodes[b.node])], _hash(b.text)): b for b in page.blocks if not b.boiler
            }
            article = {h for (_, h), b in found.items() if b.rooted} or {h for _, h in found}
            skeletons.append(dump(page.tree))
            paths.append(sorted(set(marks(page.tree).values())))
            contents.append(_hash(" ".join(map(str, sorted(article)))) if article else None)
            blocks.append(
                [
                    {"node": n, "hash": h, "chars": len(b.text), "links": b.links, "rooted": b.rooted}
                    for (n, h), b in found.items()
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("host"),
                pa.array(skeletons, pa.string()),
                pa.array(paths, pa.list_(pa.int64())),
                pa.array(contents, pa.int64()),
                pa.array(blocks, pa.list_(block)),
            ],
            names=["host", "skeleton", "paths", "content", "blocks"],
        )


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeletons with their host's frequent nodes only."""
    for batch in batches:
        texts = [
            dump(pruned(load(s), set(kept)))
            for s, kept in zip(batch.column("skeleton").to_pylist(), batch.column("kept").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(texts, pa.string())], names=["host", "skeleton"])


ALIGNED = "host string, content long, node int, hash long, chars long, links long, rooted boolean"


def aligned_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page that stand in a node of the host's wrapper, by that node."""
    names = ["host", "content", "node", "hash", "chars", "links", "rooted"]
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.bool_()]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for row in batch.to_pylist():
            page = _cached(_TREES, 1_000, row["skeleton"], load)
            found = places(page, _cached(_TREES, 1_000, row["wrapper"], load))
            nodes = preorder(page)
            for b in row["blocks"]:
                at = found.get(id(nodes[b["node"]]), -1)
                values = (row["host"], row["content"], at, b["hash"], b["chars"], b["links"], b["rooted"])
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def wrappers(skeletons: DataFrame, *, fan_in: int = FAN_IN) -> DataFrame:
    """``host, skeleton``: one merged tree per host, from distinct skeletons, in rounds."""

    def merged(rows: pa.Table) -> pa.Table:
        trees = [load(s) for s in sorted(rows.column("skeleton").to_pylist())]
        whole = trees[0]
        for other in trees[1:]:
            whole = merge(whole, other)
        return pa.table({"host": rows.column("host").slice(0, 1), "skeleton": pa.array([dump(whole)])})

    rows = skeletons.select("host", "skeleton").distinct()
    while True:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // fan_in)
        bucket = F.pmod(F.xxhash64("skeleton"), F.lit(max(1, groups))).alias("bucket")
        rows = stash(
            rows.groupBy("host", bucket).applyInArrow(merged, "host string, skeleton string"), "wrappers"
        )
        if groups <= 1:
            return rows


def induce(
    pages: DataFrame,
    *,
    min_pages: int = MIN_PAGES,
    constant_share: float = CONSTANT_SHARE,
    node_share: float = NODE_SHARE,
    fan_in: int = FAN_IN,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``host, wrapper, rules``: per host the merged tree, and as JSON what its nodes hold.
    ``pages`` has ``host`` and ``html``."""
    seen = stash(pages.select("host", "html").mapInArrow(survey, SURVEY), "survey")
    sizes = seen.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = (
        seen.select("host", F.explode("paths").alias("path"))
        .groupBy("host", "path")
        .count()
        .join(sizes, "host")
        .where(F.col("count") >= F.lit(node_share) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("path").alias("kept"))
    )
    short = (
        seen.select("host", "skeleton").distinct().join(frequent, "host")
        .mapInArrow(shortened, "host string, skeleton string")
    )
    trees = stash(wrappers(short, fan_in=fan_in).withColumnRenamed("skeleton", "wrapper"), "trees")
    blocks = stash(
        seen.select("host", "content", "skeleton", "blocks")
        .join(small(trees, "wrapper", broadcast_bytes), "host")
        .mapInArrow(aligned_blocks, ALIGNED),
        "aligned",
    )
    # A text counts once with each content that it accompanies, and so does a node.
    held = blocks.where("node >= 0").select("host", "node", "content").distinct().groupBy("host", "node").agg(
        F.count("*").alias("n")
    )
    constants = (
        blocks.where("node >= 0").select("host", "node", "hash", "content").distinct()
        .groupBy("host", "node", "hash").agg(F.count("*").alias("times"))
        .where(F.col("times") >= min_pages)
        .join(held, ["host", "node"])
        .where(F.col("times") >= F.lit(constant_share) * F.col("n"))
        .select("host", "node", "hash")
    )
    constants = stash(constants, "constants")
    nodes = (
        blocks.join(constants, ["host", "node", "hash"], "left_anti")
        .groupBy("host", "node", "rooted")
        .agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    )
    nodes = stash(nodes.join(held, ["host", "node"], "left"), "nodes")
    # At most one entry per wrapper node and side of its articles, and few constants per node.
    of_nodes = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "rooted", "chars", "links", "n")).alias("nodes"))
    of_texts = constants.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("constants"))

    def rules_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [
                json.dumps(decide(r["nodes"] or [], r["constants"] or [], min_pages))
                for r in batch.select(["nodes", "constants"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("wrapper"), pa.array(rules, pa.string())],
                names=["host", "wrapper", "rules"],
            )

    return (
        trees.join(of_nodes, "host", "left")
        .join(of_texts, "host", "left")
        .select("host", "wrapper", "nodes", "constants")
        .mapInArrow(rules_of, "host string, wrapper string, rules string")
    )


def small(df: DataFrame, column: str, most: int) -> DataFrame:
    """``df``, to be broadcast if its texts hold no more than ``most`` bytes."""
    size = df.agg(F.sum(F.octet_length(column) + F.octet_length("host") + 32)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def decide(nodes: list[dict], constants: list[dict], min_pages: int) -> dict:
    """Whether articles are told by their marks on this host, its menus and its constant texts."""
    menus = [x for x in nodes if not x["rooted"] and 2 * x["links"] > x["chars"] and (x["n"] or 0) >= min_pages]
    gone = {x["node"] for x in menus}
    varying = [x for x in nodes if x["rooted"] or x["node"] not in gone]
    total, marked = sum(x["chars"] for x in varying), sum(x["chars"] for x in varying if x["rooted"])
    return {
        "marked": 2 * marked >= total,
        "menus": sorted(gone),
        "constants": [[c["node"], c["hash"]] for c in constants],
    }


def _read_rules(text: str | None) -> tuple[bool, frozenset, frozenset]:
    found = json.loads(text) if text else {"marked": True, "menus": [], "constants": []}
    return found["marked"], frozenset(found["menus"]), frozenset((n, h) for n, h in found["constants"])


def main_text(html: str | None, rules: str | None, wrapper: str | None = None) -> str:
    marked, menus, constants = _cached(_RULES, 1_000, rules, _read_rules)
    page = Page(html)
    blocks = [b for b in page.blocks if not b.boiler]
    if marked and any(b.rooted for b in blocks):
        blocks = [b for b in blocks if b.rooted]
    if wrapper and (menus or constants):
        found = places(page.tree, _cached(_TREES, 1_000, wrapper, load))
        at = [found.get(id(page.nodes[b.node]), -1) for b in blocks]
        varying = [
            b
            for b, n in zip(blocks, at, strict=True)
            if (b.rooted or n not in menus) and (n, _hash(b.text)) not in constants
        ]
        # A page of which no more than headings varies is a copy of an article.
        if not all(b.heading for b in varying) or all(b.heading for b in blocks):
            blocks = varying
    return "\n".join(b.text for b in blocks)


def extract(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    constant_share: float = CONSTANT_SHARE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``page_id, url, text`` of every page."""
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(host(F.col(url_col)), F.lit("")).alias("host"),
        F.col(html_col).alias("html"),
    )
    learnt = stash(
        induce(rows, min_pages=min_pages, constant_share=constant_share, broadcast_bytes=broadcast_bytes), "rules"
    )
    rules = small(learnt.withColumn("both", F.concat("wrapper", "rules")), "both", broadcast_bytes).drop("both")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "rules", "wrapper"))
            texts = [main_text(h, r, w) for h, r, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    kind = dict(rows.dtypes)["page_id"]
    return (
        rows.join(rules, "host", "left")
        .select("page_id", "url", "html", "rules", "wrapper")
        .mapInArrow(read, f"page_id {kind}, url string, text string")
    )
