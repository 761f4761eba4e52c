"""Near-duplicate classes from bottom-k sketches of one hash function.

1. Every text becomes its set of hashed five-word shingles; texts with equal sets are one
   node from here on, known by a digest of the set. A node's sketch is its k smallest hashes.
2. Inverted lists of retained values give the overlaps. Two sets that are 75 % alike share
   at least ``c`` of their k retained values (but for a chance below ``MISS``), so a node
   is listed only under its ``n - c + 1`` rarest values: passages that many texts share are
   common values and drop out, and still every such pair meets in a list.
3. A short list gives all its pairs. In a long one every node is paired with the list's
   leader, the node whose values are most common in the corpus: the original of a group of
   copies. That is linear in the list.
4. The union sketch of a pair estimates its similarity; what cannot reach the threshold goes.
   The full shingle sets decide on the rest.
5. Links are turned into classes by alternating large-star and small-star rounds.
6. Long lists with members in another class than their leader are settled by the full sets:
   of two that are alike, the smaller has one of its rarest seventh of shingles (about) among
   the rarest quarter of the other's. Those shingles give new lists, short and long, treated
   as in 3 to 5. Texts of one template below the threshold share none of them and never
   meet, so this grows with the shingles of these members.
7. Members of a long list of such shingles that still are in another class than its leader
   are compared with all members of the leader's lists, in blocks of ``BLOCK`` nodes and on
   the full sets. So no link is lost; this step alone grows with (nodes left over) x (nodes of
   the list) / ``BLOCK``, and returns at most one link for each node that it joins.

Defined cases: a null or empty text, or one without words, has no shingles, is its own class
and linked with nothing; a text of fewer words than a shingle has one shingle, the whole
sequence; a null id is never a class id, and its row is kept only by ``keep``; repeated rows
are equal sets; of ties in id ``keep`` leaves one row; other columns are not read by
``classes`` and given back unchanged by ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import UPPER, fresh, hinted, stash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
PERCENT = 75
SKETCH = 32
MISS = 1e-9
SHORT_LIST = 16
BLOCK = 512
BATCH_CHARS = 4 << 20
BROADCAST_NODES = 500_000
#: ASCII capitals to small letters, ASCII white space to blanks.
TABLE = bytes(
    b + 32 if chr(b) in UPPER and b < 128 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256)
)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes all their bits depend on each other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, ascending."""
    encoded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join(encoded).translate(TABLE), np.uint8)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded)))))
    inside = raw != 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    data = pa.py_buffer(raw[inside].tobytes())
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), data]).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64)
    hashes = known[words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.uint64)
    firsts = np.searchsorted(starts, begins)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled = rolled * STEP + hashes[j : n - width + 1 + j]
    rolled = _mixed(rolled)
    sets = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            # The count tells short sequences from shingles.
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = whole * STEP + h
            sets.append(_mixed(whole))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _signed(values: np.ndarray) -> np.ndarray:
    """As signed numbers in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def node_of(values: np.ndarray) -> bytes:
    return blake2b(values.tobytes(), digest_size=16).digest()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows in portions of about ``BATCH_CHARS``, with their shingle sets; the text is the last column."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            held.append(part)
            size += part.column(part.num_columns - 1).nbytes
            if size >= BATCH_CHARS:
                table = pa.Table.from_batches(held)
                yield table, shingle_sets(table.column(table.num_columns - 1).to_pylist())
                held, size = [], 0
    if held:
        table = pa.Table.from_batches(held)
        yield table, shingle_sets(table.column(table.num_columns - 1).to_pylist())


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, h, n_shingles, node, sketch`` for ``docs`` with ``doc_id, h, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sets in _batches(batches):
            small = [_signed(s[:k]) for s in sets]
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in small]))).astype(np.int32)
            flat = np.concatenate([*small, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks(),
                    table.column("h").combine_chunks(),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                ],
                names=["doc_id", "h", "n_shingles", "node", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, h long, n_shingles long, node binary, sketch array<long>")


def shared_at_least(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """How many of n retained values two sets share, if ``percent`` of all do, but for a chance of ``miss``."""
    p, total, c = percent / 100, 0.0, 0
    while c < n:
        total += math.comb(n, c) * p**c * (1 - p) ** (n - c)
        if total > miss:
            break
        c += 1
    return max(1, c)


def _table(values: list[int], at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at)


def lists(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """``v, node, score``: nodes under their rarest retained values that occur twice or more."""
    needed = [0] + [shared_at_least(n, percent) for n in range(1, k + 1)]
    values = nodes.select("node", F.size("sketch").alias("n"), F.explode("sketch").alias("v"))
    # Counts are written before they are joined: a join of two plain shuffles can split the
    # partition of a value that a third of all nodes retain, one with an aggregate cannot.
    df = stash(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    met = values.join(df, "v")
    own = met.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own"))  # k at most
    room = F.col("n") - _table(needed, F.col("n")) + 1
    rare = F.greatest(F.lit(0), room - (F.col("n") - F.size("own")))
    score = F.aggregate("own", F.lit(0.0), lambda s, x: s + F.log2(x["df"].cast("double")))
    return own.select(
        "node", score.alias("score"), F.explode(F.slice("own", F.lit(1), rare)).alias("x")
    ).select(F.col("x.v").alias("v"), "node", "score")


def candidates(entries: DataFrame, short_list: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of short lists, and ``leader, node`` of long ones; both distinct."""
    heads = entries.groupBy("v").agg(
        F.count("*").alias("m"), F.max(F.struct("score", "node")).alias("head")
    ).where("m > 1")
    listed = stash(entries.join(stash(heads, "heads"), "v"), "listed")
    # Lists of a fixed length at most.
    bags = listed.where(F.col("m") <= short_list).groupBy("v").agg(F.sort_array(F.collect_list("node")).alias("bag"))
    pairs = bags.select(
        F.inline(
            F.flatten(
                F.transform(
                    "bag",
                    lambda x, i: F.transform(
                        F.slice("bag", i + 2, F.size("bag")), lambda y: F.struct(x.alias("a"), y.alias("b"))
                    ),
                )
            )
        )
    ).distinct()
    stars = (
        listed.where(F.col("m") > short_list)
        .select(F.col("head.node").alias("leader"), "node")
        .where("leader != node")
        .distinct()
    )
    return pairs, stars


def plausible(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose union sketch does not rule the threshold out, nor their sizes."""
    a = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    b = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    needed = [0] + [shared_at_least(n, percent) for n in range(1, k + 1)]
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(a, "a").join(b, "b").where(sizes & (common >= _table(needed, F.size(union)))).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, broadcast_nodes: int) -> DataFrame:
    """``node, values`` (binary) of the wanted ``node, doc_id, h``."""
    keys = hinted(wanted.select("doc_id", "h"), broadcast_nodes)
    same = docs["doc_id"].eqNullSafe(keys["doc_id"]) & (docs["h"] == keys["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _batches(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "values"],
            )

    texts = docs.join(keys, same, "left_semi").select("text")
    return texts.mapInArrow(run, "node binary, values binary").dropDuplicates(["node"])


def _alike(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)
            ok = pa.array([_alike(x, y, percent) for x, y in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    a = sets.select(F.col("node").alias("a"), F.col("values").alias("va"))
    b = sets.select(F.col("node").alias("b"), F.col("values").alias("vb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all linked nodes, by alternating large and small stars.

    Each round writes its edges, so a lost executor costs one round. Minima are partial
    aggregates, and a node with very many neighbours can be split in the joins.
    """

    def star(edges: DataFrame, low: DataFrame, large: bool) -> DataFrame:
        joined = edges.join(low, "u")
        if large:  # every larger neighbour is tied to the smallest
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every smaller neighbour, and the node itself
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )

    edges = stash(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stash(star(both, low, True).where("u != v").distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = star(down, stash(down.groupBy("u").agg(F.min("v").alias("m")), "low"), False)
        edges = stash(small.where("u != v").distinct(), "edges")
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s"),
            F.count_distinct("u").alias("d"),
        ).first()
        # At rest every node points at one root, and a round changes nothing.
        if mark == (now.n, now.s):
            break
        mark = (now.n, now.s)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_links(rest: list[tuple], whole: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between classes, of nodes of ``rest`` with nodes of ``whole``; both hold
    ``(node, root, values)``. Pairs that are already joined give no link."""
    parent = {root: root for _, root, _ in (*rest, *whole)}
    roots = [root for _, root, _ in whole]
    sizes = np.array([len(v) // 8 for _, _, v in whole])
    values = np.concatenate([np.frombuffer(v, np.uint64) for _, _, v in whole])
    owners = np.repeat(np.arange(len(whole)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    found = []
    for node, root, own in rest:
        mine = np.frombuffer(own, np.uint64)
        low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        counts = high - low
        ends = np.cumsum(counts)
        take = np.repeat(low - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        common = np.bincount(owners[take], minlength=len(whole))
        for k in np.flatnonzero(100 * common >= percent * (sizes + len(mine) - common)).tolist():
            x, y = _find(parent, root), _find(parent, roots[k])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((node, whole[k][0]))
    return found


def unsettled(stars: DataFrame, rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leader, node, root, rest`` of all members of long lists, where ``rest`` tells those in
    another class than their leader, and ``leader, all, few`` of the leaders that have such."""
    roots = rooted.select("node", "root")
    members = stars.union(stars.select("leader", F.col("leader").alias("node")).distinct())
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = roots.select(F.col("node").alias("leader"), F.col("root").alias("head"))
    named = stash(
        named.join(heads, "leader", "left").withColumn("rest", F.col("root") != F.coalesce("head", "leader")).drop("head"),
        "members",
    )
    sizes = named.groupBy("leader").agg(F.count("*").alias("all"), F.count_if("rest").alias("few")).where("few > 0")
    return named, stash(sizes, "sizes")


def rare_lists(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``v, node, score``: the nodes under the rarest shingles of their full sets, as far as two that
    are alike must share one. Rare is what few of these nodes hold; one that a single node holds is in
    no list. Of two alike sets the smaller shares at least ``2 * percent / (100 + percent)`` of its
    shingles, the other ``percent`` of its own, so shingles that no node has among its rarest by the
    first measure are left out."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_signed(np.frombuffer(v, np.uint64)) for v in batch.column("values").to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(v) for v in own]))).astype(np.int32)
            flat = np.concatenate([*own, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([len(v) for v in own], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                ],
                names=["node", "n", "values"],
            )

    values = (
        sets.join(nodes, "node", "left_semi")
        .select("node", "values")
        .mapInArrow(unpacked, "node binary, n long, values array<long>")
        .select("node", "n", F.explode("values").alias("v"))
    )
    df = stash(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "rare")
    own = values.join(df, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own"))
    single = F.col("n") - F.size("own")
    apart = [F.expr(f"n - ((n * {a} + {b} - 1) div {b}) + 1") for a, b in ((percent, 100), (2 * percent, 100 + percent))]
    probed, indexed = (F.greatest(F.lit(0), (x - single)).cast("int") for x in apart)
    listed = stash(
        own.select("node", indexed.alias("few"), F.slice("own", F.lit(1), probed).alias("own"))
        .select(
            "node",
            "few",
            F.aggregate("own", F.lit(0.0), lambda s, x: s + F.log2(x["df"].cast("double"))).alias("score"),
            F.posexplode("own").alias("at", "x"),
        )
        .select("node", "score", F.col("x.v").alias("v"), (F.col("at") < F.col("few")).alias("first")),
        "lists",
    )
    return listed.join(listed.where("first").select("v").distinct(), "v", "left_semi").select("v", "node", "score")


def left_over(stars: DataFrame, rooted: DataFrame, block: int) -> DataFrame:
    """``leader, i, j, rest, node, root``: what has to meet, in pairs of blocks. ``stars`` has
    ``leader, node``; ``rooted`` gives the root of the nodes that have links."""
    named, open_lists = unsettled(stars, rooted)
    sizes = open_lists.select(
        "leader", F.ceil(F.col("all") / block).alias("gj"), F.ceil(F.col("few") / block).alias("gi")
    )
    dealt = named.join(stash(sizes, "sizes"), "leader")
    number = F.xxhash64("node")
    whole = dealt.select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("gi").cast("int") - 1)).alias("i"),
        F.pmod(number, F.col("gj")).cast("int").alias("j"), F.lit(False).alias("rest"), "node", "root",
    )
    rest = dealt.where("rest").select(
        "leader", F.pmod(number, F.col("gi")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("gj").cast("int") - 1)).alias("j"), F.lit(True).alias("rest"), "node", "root",
    )
    return whole.union(rest)


def resolved(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that the blocks of ``left_over`` hold."""

    def run(rows: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for r in rows.select(["rest", "node", "root", "values"]).to_pylist():
            sides[0 if r["rest"] else 1].append((r["node"], r["root"], r["values"]))
        found = block_links(*sides, percent) if sides[0] and sides[1] else []
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    with_sets = blocks.join(sets, "node").select("leader", "i", "j", "rest", "node", "root", "values")
    return with_sets.groupBy("leader", "i", "j").applyInArrow(run, "a binary, b binary")


def classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    k: int = SKETCH,
    short_list: int = SHORT_LIST,
    block: int = BLOCK,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, h, n_shingles, component_id``; ``h`` is the text's xxhash64."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")
    )
    seen = stash(sketched(texts, k), "sketches")
    nodes = stash(
        seen.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            # A row without an id stands for the set only where no other does.
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("own"),
            F.first("sketch").alias("sketch"),
            F.first("n_shingles").alias("n_shingles"),
        ),
        "nodes",
    )
    short, stars = candidates(stash(lists(nodes, k, percent), "lists"), short_list)
    stars = stash(stars, "stars")
    ordered = stars.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    pairs = stash(plausible(short.union(ordered).distinct(), nodes, k, percent), "pairs")

    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    met = met.union(stars.select("node")).union(stars.select(F.col("leader").alias("node"))).distinct()
    wanted = stash(nodes.join(met, "node").select("node", "own.doc_id", "own.h"), "wanted")
    sets = stash(full_sets(texts, wanted, broadcast_nodes), "sets")

    links = stash(verified(pairs, sets, percent), "links")
    first = stash(components(links), "classes")
    rooted = first
    members, open_lists = unsettled(stars, first)
    again = members.join(open_lists, "leader", "left_semi").select("node").distinct()
    if not open_lists.isEmpty():
        short, stars = candidates(stash(rare_lists(again, sets, percent), "lists"), short_list)
        stars = stash(stars, "stars")
        ordered = stars.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
        pairs = stash(plausible(short.union(ordered).distinct(), nodes, k, percent), "pairs")
        links = stash(links.union(verified(pairs, sets, percent)), "links")
        rooted = stash(components(links), "classes")
        more = stash(resolved(left_over(stars, rooted, block), sets, percent), "links")
        if not more.isEmpty():
            rooted = stash(components(links.union(more)), "classes")
    named = nodes.select("node", F.col("own.doc_id").alias("least")).join(rooted, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    ids = stash(named.groupBy("root").agg(F.min("least").alias("component")), "ids")
    of_node = named.join(ids, "root").select("node", "component")
    return seen.join(of_node, "node", "left").select(
        "doc_id",
        "h",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = BROADCAST_NODES,
    **settings,
) -> DataFrame:
    """One document of each class, the one with its smallest id, with all columns. Rows
    without an id have nothing to be chosen by and stay."""
    found = stash(classes(docs, id_col=id_col, text_col=text_col, **settings).where("doc_id IS NOT NULL"), "found")
    i, h = fresh(docs, "class_id"), fresh(docs, "class_text")
    # A row stays if its id is the class's; where rows of that id differ in text, the least hash.
    heads = found.where("doc_id = component_id").groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    best = heads.groupBy("doc_id").agg(F.min("h").alias("h"), F.lit(True).alias("first"))
    heads = heads.join(best, ["doc_id", "h"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    others = found.where("doc_id != component_id").select("doc_id", "h").distinct()
    judged = heads.unionByName(others.withColumns({"n": F.lit(1), "first": F.lit(False)}))
    # The rows that go, and those of which one stays, are few as a rule: only they are joined.
    judged = stash(judged.where("NOT first OR n > 1").withColumnsRenamed({"doc_id": i, "h": h}), "judged")
    same = docs[id_col].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(h))
    gone = hinted(judged.select(i, h), broadcast_rows)
    again = hinted(judged.where("first").select(i, h), broadcast_rows)
    once = docs.join(again, same, "inner").dropDuplicates([i, h]).select(docs.columns)
    return docs.join(gone, same, "left_anti").unionByName(once)
