"""URL filter: a blocked Bloom filter in front of an exact hash join.

The listed canonical URLs set one bit in each of the eight 32-bit words of one block. The
filter has a fixed upper size (``max_blocks``), so it may be broadcast whatever the list's
length: an overfull filter lets more URLs pass to the exact join, and never changes a
result. Only possible hits are shuffled; all other pages stay in the scanning tasks.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no canonical
form, and is never listed; repeated pages are judged each; an empty list blocks nothing;
equal rules count once; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ascii_lower, let, power_of_two, stash

WORDS = 8
#: 2**17 blocks of 32 bytes: a filter of 4 MB.
MAX_BLOCKS = 1 << 17
BITS_PER_URL = 12
#: Query parameters that only track visits.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    """What stands after the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)([^?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^([^/?#]*)([^?#]*)", 2)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, and the sorted
    query parameters that do not only track. Scheme and fragment do not count."""

    def of(rest: Column) -> Column:
        name = F.regexp_replace(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), r"^www[.]|:(80|443)$", "")
        where = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), r"/+$", "")
        query = F.regexp_extract(rest, r"^[^?#]*[?]([^#]*)", 1)
        kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
        return F.concat(name, where, F.lit("?"), F.array_join(kept, "&"))

    return F.when(F.instr(url, "://") > 0, let(_rest(url), of))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The key's bit in this word, from five bits of a second hash."""
    place = F.shiftright(F.xxhash64(key, F.lit("bits")), 5 * word).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1), place)


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter's blocks that have bits: ``block, w0 .. w7``. ``listed`` has a column ``key``."""
    key = F.col("key")
    return listed.groupBy(_block(key, n_blocks).alias("block")).agg(
        *(F.bit_or(_bit(key, i)).alias(f"w{i}") for i in range(WORDS))
    )


def _rule(rules: dict[str, str], name: Column, where: Column) -> Column:
    """The longest fitting rule's text. A rule ``host/path`` fits its host and subdomains."""
    longest = sorted(rules, key=lambda r: (-len(r), r))
    tests = []
    for rule in longest:
        cut = rule.index("/")
        own, start = rule[:cut], rule[cut:]
        fits = ((name == own) | name.endswith("." + own)) & where.startswith(start)
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: dict[str, str],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical, listed`` for every page.

    ``rules`` maps ``host/path`` to allow or block and wins over the list; it is part of the
    plan and meant for up to some hundred rules. ``listed`` holds the blocked URLs.
    """
    keys = stash(
        listed.select(canonical(F.col(listed_col)).alias("key")).where("key IS NOT NULL").distinct(), "listed"
    )
    n_blocks = power_of_two(keys.count() * BITS_PER_URL / (32 * WORDS), 16, max_blocks)
    blocks = bloom(keys, n_blocks)

    url, key = F.col("u"), F.col("canonical")
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select(
        "page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical")
    )
    has = reduce(
        lambda a, b: a & b,
        (_bit(key, i).bitwiseAND(F.col(f"w{i}")) != 0 for i in range(WORDS)),
    )
    probed = (
        named.withColumn("block", _block(F.coalesce(key, F.lit("")), n_blocks))
        .join(F.broadcast(blocks), "block", "left")
        .withColumn("maybe", F.coalesce(key.isNotNull() & has, F.lit(False)))
        .select("page_id", "host", "path", "canonical", "maybe")
    )
    # Left join: where one URL has very many pages, its partition can be split at run time.
    exact = probed.where("maybe").join(keys.select(F.col("key").alias("canonical"), F.lit(True).alias("listed")),
                                       "canonical", "left")
    clear = probed.where("NOT maybe").withColumn("listed", F.lit(False))
    both = exact.select(clear.columns).unionByName(clear)
    rule = _rule(rules, F.col("host"), F.col("path"))
    verdict = F.coalesce(
        *(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()),
        F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")),
    )
    return (
        both.withColumn("listed", F.coalesce("listed", F.lit(False)))
        .withColumn("rule", rule)
        .withColumn("verdict", verdict)
        .select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")
    )
