"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit
per failed rule; a policy is a versioned mask over these bits, so another policy, or the
effect of leaving a rule out, is computed from the ledger and never from the texts. All of
it is one projection over the texts: nothing is shuffled but the ablation's few counts.

Defined cases: a null or empty text has no words and fails ``short``; repeated rows are
judged each on its own; only the id and the text are read, so other columns may have any
names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import BLANK, blank_words, fresh, let

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper",
)


def _covered(starts: Column) -> Column:
    """Words inside the three-word windows that begin at the ascending ``starts``."""
    return F.aggregate(
        F.transform(
            starts,
            lambda s, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), s - F.get(starts, k - 1))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which stands twice or more in ``words``.

    The windows are sorted with their places, so equal ones are neighbours: n log n for a
    text of any length, and exact because the windows themselves are compared.
    """

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i")
            ),
        )
        same = lambda s, x, k: F.coalesce(x["w"] == F.get(s, k)["w"], F.lit(False))
        again = lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1))
        starts = let(F.sort_array(windows), lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(starts, _covered))

    return let(words, of)


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measurements(text: Column) -> Column:
    """All measurements of one text, as a struct of longs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column, kept_lines: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(text, BLANK + "+", "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
            "n_dup_lines": F.size(kept_lines) - F.size(F.array_distinct(kept_lines)),
            "n_repeat_words": repeat_words(words),
            "n_lines": F.size(kept_lines),
            "n_letters": _without(text, r"\p{L}+"),
            "n_upper": _without(text, r"\p{Lu}+"),
        }
        return F.struct(*(values[n].cast("long").alias(n) for n in MEASURES))

    return let(blank_words(text), lambda words: let(lines, lambda kept: of(words, kept)))


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` is true; it gets the measurements by name. Bits are
    never given to another rule, so that old ledgers keep their meaning."""

    bit: int
    name: str
    fails: Callable[[Mapping[str, Column]], Column]


RULES = (
    Rule(0, "short", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule(3, "capitals", lambda m: 100 * m["n_upper"] > 30 * m["n_letters"]),
    Rule(4, "few_letters", lambda m: 100 * m["n_letters"] < 60 * m["word_chars"]),
    Rule(5, "repeated_lines", lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"]),
    Rule(
        6,
        "word_length",
        lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]),
    ),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base-1", ("short", "repeated_words"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def fail_bits(measured: Mapping[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        (F.when(r.fails(measured), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules),
    )


def ledger(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per document: id, measurements, ``fail_bits``."""
    text = F.coalesce(F.col("t"), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
        .select("doc_id", measurements(text).alias("m"))
        .select("doc_id", "m.*")
        .withColumn("fail_bits", fail_bits({n: F.col(n) for n in MEASURES}, rules))
    )


def apply_policy(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept`` and the policy's ``version``."""
    passed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0
    return entries.withColumn("kept", passed).withColumn("version", F.lit(policy.version))


def ablation(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that only it rejects.

    Rows are first counted by their bits, of which there are at most two to the number of rules.
    """
    mask = policy.mask(rules)
    own = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                    for r in rules if r.name in policy.rules))
    return (
        entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits"))
        .agg(F.count("*").alias("n"))
        .select("bits", "n", F.inline(own))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def keep(docs: DataFrame, policy: Policy = STANDARD, *, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    m = fresh(docs, "quality_measures")
    judged = docs.withColumn(m, measurements(F.coalesce(F.col(text_col), F.lit(""))))
    bits = fail_bits({n: F.col(m)[n] for n in MEASURES})
    return judged.where(bits.bitwiseAND(F.lit(policy.mask())) == 0).drop(m)
