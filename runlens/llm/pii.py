"""Personal data: base patterns, and terms that disclose a protected value.

Emails, addresses, card and phone numbers are protected entities. A term discloses an entity
when seeing the term tells nearly as much as seeing the entity: with documents as events,
``PMI(e, t) = log(N * n(e, t) / (n(e) * n(t)))`` is compared with ``IC(e) = log(N / n(e))``,
the information in the entity itself. ``n(e, t)`` counts documents where the term stands
within ``radius`` characters of the entity; ``n(t)`` counts documents of the whole corpus.
A term at ``generalise_at`` of ``IC`` or more is generalised, at ``remove_at`` removed, in
every document that holds the entity, at any distance from it. Terms are words of three or
more letters, marks and digits, whatever stands around them.

``PMI`` is ``log(P(e|t) / P(e))``, and few documents say little about ``P(e|t)``. It is
estimated from ``k`` independent observations, the documents with different surroundings of
the pair (copies of one passage count once), beside one more that knows only ``P(e)``:
``(k * n(e, t) / n(t) + P(e)) / (k + 1)``. No number of documents is required.

All patterns run in one linear pass each: atomic repeats, and a start only where a run of
characters begins or where the last match ended, give the same leftmost matches as the plain
patterns. Corpus counts are partial aggregates over single rows.

Defined cases: a null or empty text has no spans; repeated rows are judged each, by id and
text; an entity in every document carries no information and discloses nothing; base spans
stay, and a term that overlaps one is dropped; ids may be null; only the id and the text
are read, and ``sanitise`` gives all other columns back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fresh, hinted, let, stash

RADIUS = 80
GENERALISE_AT, REMOVE_AT = 0.9, 0.99
#: Candidate terms up to this number are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: The same for entities with disclosing terms.
BROADCAST_ENTITIES = 100_000

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:[.][0-9]++){3}",
    # A whole run of digits with single separators, if it has 16 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SPANS = "array<struct<s:int,e:int,v:string>>"
_WORD = r"\p{L}\p{M}\p{N}"
# A word that the window cuts has nothing before or after it.
TERM = rf"(?<=[^{_WORD}])[{_WORD}]{{3,}}+(?=[^{_WORD}])"
NOT_WORD = rf"[^{_WORD}]+"


def locate(text: Column, pattern: Column) -> Column:
    """All matches as ``(s, e, v)``, in code points, end exclusive. The gaps between matches
    are what a split leaves, so their lengths give the places."""

    def of(gaps: Column, found: Column) -> Column:
        begun = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

        def step(state: Column, k: Column) -> Column:
            s = state["at"] + F.length(F.get(gaps, k))
            e = s + F.length(F.get(found, k))
            span = F.struct(s.alias("s"), e.alias("e"), F.get(found, k).alias("v"))
            return F.struct(e.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        places = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begun, step)["out"]
        return F.when(F.size(found) > 0, places).otherwise(F.expr(f"cast(array() as {_SPANS})"))

    return let(
        F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda g: of(g, m))
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:[.]{_PART}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Struct of one array of ``(s, e, v)`` per kind; texts without a kind's mark are skipped."""
    marks = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike("[.][0-9]+[.]"),
        "card": text.rlike("[0-9](?:[ -]?[0-9]){15}"),
        "phone": F.contains(text, F.lit("+")),
    }
    none = F.expr(f"cast(array() as {_SPANS})")

    def of(kind: str) -> Column:
        found = F.filter(locate(text, F.lit(PATTERNS[kind])), lambda x: _valid(kind, x["v"]))
        return F.when(marks[kind], found).otherwise(none).alias(kind)

    return F.struct(*(of(k) for k in KINDS))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    ).withColumn("h", F.xxhash64("t"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def _some(base: str = "base") -> str:
    return " OR ".join(f"size({base}.{k}) > 0" for k in KINDS)


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(kind + ":"), plain)


def contexts(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """``doc_id, h, entity, context, term``: terms around each entity; one row with a null
    term where there are none. ``docs`` has ``base``."""

    def around(kind: str) -> Column:
        def of(x: Column) -> Column:
            # One character more on each side, and a blank at both ends of the text, tell whole words.
            ahead = F.greatest(x["s"] - radius - 1, F.lit(0))
            before = F.concat(
                F.when(x["s"] <= radius, F.lit(" ")).otherwise(F.lit("")), F.substr("t", ahead + 1, x["s"] - ahead)
            )
            after = F.substr(F.concat("t", F.lit(" ")), x["e"] + 1, F.lit(radius + 1))
            near = F.lower(F.concat(before, F.lit(" | "), after))
            return F.struct(_entity(kind, x["v"]).alias("entity"), near.alias("near"))

        return F.transform(F.col(f"base.{kind}"), of)

    return (
        docs.where(_some())
        .select("doc_id", "h", F.inline(F.concat(*(around(k) for k in KINDS))))
        .select(
            "doc_id",
            "h",
            "entity",
            F.xxhash64("near").alias("context"),
            F.explode_outer(F.array_distinct(F.regexp_extract_all("near", F.lit(TERM), F.lit(0)))).alias("term"),
        )
    )


def disclosures(
    docs: DataFrame,
    near: DataFrame,
    *,
    generalise_at: float = GENERALISE_AT,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """``entity, term, share``: terms that reach ``generalise_at`` of the entity's information.

    ``docs`` has ``doc_id, h, t`` for the whole corpus, ``near`` comes from ``contexts``.
    """
    event = F.struct("doc_id", "h")
    n = F.lit(docs.count()).cast("double")
    n_e, n_et, n_contexts = (F.col(c).cast("double") for c in ("n_e", "n_et", "n_contexts"))
    k, p_e = F.least(n_contexts, n_et), n_e / n

    def share(n_t: Column) -> Column:
        """The share of the entity's information; falls as ``n_t`` grows."""
        p_et = (k * F.least(n_et, n_t) / n_t + p_e) / (k + 1)
        return F.log(p_et / p_e) / -F.log(p_e)

    pairs = near.where(F.col("term").isNotNull()).groupBy("entity", "term").agg(
        F.count_distinct("context").alias("n_contexts"), F.count_distinct(event).alias("n_et")
    )
    entities = near.select("entity", "doc_id", "h").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    # A term is in at least as many documents as have it near some entity. That bounds its
    # share from above, and rules out common words before the corpus is counted.
    around = near.where(F.col("term").isNotNull()).groupBy("term").agg(F.count_distinct(event).alias("n_near"))
    known = stash(
        pairs.join(entities, "entity")
        .join(around, "term")
        .where(n_e < n)
        .where(share(F.col("n_near").cast("double")) >= generalise_at),
        "pii-pairs",
    )
    wanted = stash(known.select("term").distinct(), "pii-terms")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("t"), NOT_WORD))).alias("term"))
    if wanted.limit(broadcast_terms + 1).count() <= broadcast_terms:
        # Rows of few terms are left of the corpus; beyond that, counts are joined, not rows.
        counts = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        counts = words.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")
    return (
        known.join(counts, "term")
        .withColumn("share", share(F.col("n_t").cast("double")))
        .where(F.col("share") >= generalise_at)
        .select("entity", "term", "share")
    )


def find(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """Per document: ``doc_id, h, base`` (spans by kind), ``terms`` as ``(s, e, v, removed)``."""
    texts = _keyed(docs, id_col, text_col)
    bases = texts.withColumn("base", base_spans(F.col("t")))
    found = stash(bases.drop("t"), "pii-base")
    near = stash(contexts(bases, radius=radius), "pii-near")
    flagged = disclosures(texts, near, generalise_at=generalise_at)
    # Every document that holds the entity, wherever the term stands in it.
    told = stash(flagged.groupBy("entity").agg(F.collect_list(F.struct("term", "share")).alias("told")), "pii-told")
    # Letters, marks and digits only, so the words need no quoting in a pattern.
    own = (
        near.select("doc_id", "h", "entity")
        .distinct()
        .join(hinted(told, BROADCAST_ENTITIES), "entity")
        .select("doc_id", "h", F.inline("told"))
        .groupBy("doc_id", "h", "term")
        .agg(F.max("share").alias("share"))
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("term", "share")).alias("own"))
    )
    held = bases.where(_some()).dropDuplicates(["doc_id", "h"])
    pattern = F.concat(
        F.lit(rf"(?iu)(?<![{_WORD}])(?:"),
        F.array_join(F.transform("own", lambda x: x["term"]), "|"),
        F.lit(rf")(?![{_WORD}])"),
    )
    strong = F.transform(F.filter("own", lambda x: x["share"] >= remove_at), lambda x: x["term"])
    every = F.concat(*(F.col(f"base.{k}") for k in KINDS))
    terms = let(
        every,
        lambda spans: F.transform(
            F.filter(
                locate(F.col("t"), F.col("pattern")),
                lambda x: ~F.exists(spans, lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"])),
            ),
            lambda x: F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                x["v"].alias("v"),
                F.array_contains("strong", F.lower(x["v"])).alias("removed"),
            ),
        ),
    )
    extra = (
        held.join(own, _same(held, own))
        .select(held["doc_id"], held["h"], "t", "base", pattern.alias("pattern"), strong.alias("strong"))
        .select("doc_id", "h", terms.alias("terms"))
    )
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string,removed:boolean>>)")
    return found.join(extra, _same(found, extra), "left").select(
        found["doc_id"], found["h"], "base", F.coalesce("terms", none).alias("terms")
    )


def span_text(kind: str, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"])), ",")


def joined(*texts: Column) -> Column:
    return F.array_join(F.array_remove(F.array(*texts), ""), ",")


LABELS = {"email": "<email>", "ip": "<ip>", "card": "<card>", "phone": "<phone>"}


def _replaced(text: Column, marks: Column) -> Column:
    """``text`` with every ``(s, e, v)`` of ``marks`` replaced by ``v``; overlaps count as one."""
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        ahead = F.substr(text, state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0)))
        label = F.when(x["s"] >= state["at"], x["v"]).otherwise(F.lit(""))
        return F.struct(
            F.greatest(state["at"], x["e"]).alias("at"), F.concat(state["out"], ahead, label).alias("out")
        )

    rest = lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text)))
    return let(F.aggregate(F.sort_array(marks), begun, step), rest)


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with base spans labelled, disclosing terms generalised to ``<term>`` or removed."""
    found = find(docs, id_col=id_col, text_col=text_col, **settings)

    def marks_of(spans: str, label: Callable[[Column], Column]) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), label(x).alias("v")))

    labels = [partial(lambda text, _: F.lit(text), LABELS[k]) for k in KINDS]
    marks = F.concat(
        *(marks_of(f"base.{k}", label) for k, label in zip(KINDS, labels, strict=True)),
        marks_of("terms", lambda x: F.when(x["removed"], F.lit("")).otherwise(F.lit("<term>"))),
    )
    id_, h, m = fresh(docs, "pii_id"), fresh(docs, "pii_text"), fresh(docs, "pii_marks")
    # One row per id and text, and only those with something to replace.
    changes = (
        found.select(F.col("doc_id").alias(id_), F.col("h").alias(h), marks.alias(m))
        .where(F.size(m) > 0)
        .dropDuplicates([id_, h])
    )
    same = docs[id_col].eqNullSafe(changes[id_]) & (
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == changes[h]
    )
    text = F.col(text_col)
    clean = F.when(F.col(m).isNull(), text).otherwise(_replaced(text, F.col(m)))
    return docs.join(changes, same, "left").withColumn(text_col, clean).select(docs.columns)
