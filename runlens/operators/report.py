"""Report operators over outcome rows (``facts.outcomes``), which should be pinned.

Every "first" is a minimum over the processing order, so each operator is a mergeable
aggregate: a family with a third of all findings is reduced inside the scanning tasks.

The whole report comes from one such aggregate. Each outcome gives tagged entries, for its
state, its findings and its recommendations; grouped by tag and key they are one row per
state, family and suggestion. Header, totals and bodies are made of these few rows. Only the
highlights look at the outcomes a second time, for the first few in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import fixed as X
from runlens.functions.clock import ORDER
from runlens.functions.wording import fill, fixed
from runlens.operators.ranking import line_numbers
from runlens.storage import pin


def _order() -> Column:
    return F.struct(*ORDER)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(X.OTHER_RANK)
    for name, value in X.SEVERITY_RANKS.items():
        rank = F.when(severity == name, F.lit(value)).otherwise(rank)
    return rank


def state_counts(outcomes: DataFrame) -> DataFrame:
    """Runs per state, in order of first appearance."""
    return (
        outcomes.groupBy("job_state")
        .agg(F.count("*").alias("run_count"), F.min(_order()).alias("first_seen"))
        .orderBy("first_seen")
    )


def _issue_findings(outcomes: DataFrame) -> DataFrame:
    """Every finding, info ones too, of the runs that have an issue."""
    return (
        outcomes.where("has_issues")
        .select("*", _order().alias("seen"), F.posexplode("findings").alias("pos", "finding"))
        .withColumn("rank", severity_rank(F.col("finding.severity")))
    )


def worst_findings(outcomes: DataFrame) -> DataFrame:
    """Per family the finding of least rank, the first met on ties, with the place where
    the family first showed an issue."""
    worst = F.struct(
        "rank", "seen", "pos", "finding", "cluster_name", "baseline_median", "baseline_runs"
    )
    grouped = (
        _issue_findings(outcomes)
        .groupBy("job_id")
        .agg(F.min(worst).alias("worst"), F.min("seen").alias("first_seen"))
    )
    return _opened(grouped)


def _opened(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "job_id",
        "first_seen",
        F.col("worst.rank").alias("rank"),
        F.col("worst.seen.run_identifier").alias("run_identifier"),
        F.col("worst.seen.uid").alias("uid"),
        F.col("worst.finding.kind").alias("kind"),
        F.col("worst.finding.severity").alias("severity"),
        F.col("worst.finding.message").alias("message"),
        F.col("worst.finding.action").alias("action"),
        F.col("worst.cluster_name").alias("cluster_name"),
        F.col("worst.baseline_median").alias("baseline_median"),
        F.col("worst.baseline_runs").alias("baseline_runs"),
    )


def ranked_regressions(outcomes: DataFrame) -> DataFrame:
    """Worst findings, most severe first, then by first appearance of the family."""
    return worst_findings(outcomes).orderBy("rank", "first_seen")


def suggested_actions(outcomes: DataFrame) -> DataFrame:
    """Distinct (family, action) pairs: the worst findings' actions in ranked order, then
    all recommendations in processing order; the first place of a pair counts."""
    following = (
        outcomes.where("has_issues")
        .select("job_id", _order().alias("seen"), F.posexplode("recommendations").alias("pos", "action"))
        .select("job_id", "action", _later_place(F.col("seen"), F.col("pos")).alias("place"))
    )
    return _first_places(worst_findings(outcomes), following).orderBy("place")


def _later_place(seen: Column, pos: Column) -> Column:
    return F.struct(F.lit(1).alias("list"), F.lit(0).alias("rank"), seen.alias("seen"), pos.alias("pos"))


def _first_places(worst: DataFrame, following: DataFrame) -> DataFrame:
    leading = worst.select(
        "job_id",
        "action",
        F.struct(
            F.lit(0).alias("list"), F.col("rank"), F.col("first_seen").alias("seen"), F.lit(-1).alias("pos")
        ).alias("place"),
    )
    return (
        leading.unionByName(following)
        .where(F.col("action").isNotNull() & (F.col("action") != ""))
        .groupBy("job_id", "action")
        .agg(F.min("place").alias("place"))
    )


def highlights(outcomes: DataFrame, *, limit: int = X.HIGHLIGHTS, newest: bool = False) -> DataFrame:
    """The first runs in processing order, or the last ones with ``newest``."""
    order = [F.col(c).desc() if newest else F.col(c).asc() for c in ORDER]
    return outcomes.orderBy(*order).limit(limit)


_STATE, _FAMILY, _SUGGESTION = 0, 1, 2


def report_entries(outcomes: DataFrame) -> DataFrame:
    """``tag, key, action, n, seen, worst, place, issue``: one row per state, per family with a
    finding, and per family and recommendation, from one pass over the outcomes."""
    seen = _order()
    worst = F.transform(
        "findings",
        lambda f, i: F.struct(
            severity_rank(f["severity"]).alias("rank"), seen.alias("seen"), i.alias("pos"), f.alias("finding"),
            "cluster_name", "baseline_median", "baseline_runs",
        ),
    )
    places = F.transform("recommendations", lambda a, i: F.struct(a.alias("action"), _later_place(seen, i).alias("place")))
    kinds = outcomes.select(worst.alias("worst"), places["place"].alias("place"), places["action"].alias("action")).schema
    nothing = {f.name: F.lit(None).cast(f.dataType.elementType) for f in kinds}

    def entry(tag: int, key: str, **values: Column) -> Column:
        whole = nothing | values
        return F.struct(F.lit(tag).alias("tag"), F.col(key).alias("key"), *(whole[c].alias(c) for c in nothing))

    def entries(of: Column) -> Column:
        return F.when(F.col("has_issues"), of)

    state = F.array(entry(_STATE, "job_state"))
    families = entries(F.transform(worst, lambda w: entry(_FAMILY, "job_id", worst=w)))
    suggested = entries(
        F.transform(places, lambda p: entry(_SUGGESTION, "job_id", place=p["place"], action=p["action"]))
    )
    some = F.concat(state, *(F.coalesce(e, F.slice(state, 1, 0)) for e in (families, suggested)))
    tagged = outcomes.select("has_issues", seen.alias("seen"), F.inline(some))
    return tagged.groupBy("tag", "key", "action").agg(
        F.count("*").alias("n"),
        F.min("seen").alias("seen"),
        F.min("worst").alias("worst"),
        F.min("place").alias("place"),
        F.bool_or("has_issues").alias("issue"),
    )


def _header(states: DataFrame) -> DataFrame:
    """Title, rule and state counts, which are one line of the report."""
    named = states.select("seen", "key", "n", fill(X.REPORT_STATE, a=F.col("key"), b=F.col("n")).alias("state"))
    whole = named.agg(
        F.sum("n").alias("runs"), F.expr("listagg(state, ', ') WITHIN GROUP (ORDER BY seen, key, n)").alias("list")
    )
    counts = fill(X.REPORT_COUNTS, n=F.col("runs"), list=F.coalesce("list", F.lit("")))
    lines = F.array(F.lit(X.REPORT_TITLE), F.lit(X.REPORT_RULE), counts)
    return whole.where(F.col("runs").isNotNull()).select(F.posexplode(lines).alias("pos", "line"))


def _section(frame: DataFrame, number: int, place: Column, pos, line: Column) -> DataFrame:
    return frame.select(
        F.lit(number).alias("section"), place.alias("place"), pos.alias("pos"), line.alias("line")
    )


_PLACE = (
    "struct<list:int,rank:int,seen:struct<o1:timestamp_ntz,o1_timed:int,"
    "o2:timestamp_ntz,o2_timed:int,run_identifier:string,uid:string>,pos:int>"
)


def report_lines(outcomes: DataFrame) -> DataFrame:
    """The status report as rows, ordered by (section, place, pos).

    A report names every family with a regression, so it can be long: it stays a
    distributed frame, and ``write_report`` or ``iter_lines`` deliver it in order. The
    entries it is made of are pinned.
    """
    nowhere = F.lit(None).cast(_PLACE)
    told = pin(report_entries(outcomes))
    states = told.where(F.col("tag") == _STATE)
    families = told.where(F.col("tag") == _FAMILY)
    regressions = _opened(families.select(F.col("key").alias("job_id"), F.col("seen").alias("first_seen"), "worst"))
    suggested = _first_places(
        regressions,
        told.where(F.col("tag") == _SUGGESTION).select(F.col("key").alias("job_id"), "action", "place"),
    )
    header = _section(_header(states), 0, nowhere, F.col("pos"), F.col("line"))
    # The bodies below depend on one row of totals.
    any_run = states.agg(F.sum("n").alias("runs"))
    nothing = F.lit(0).cast("bigint")
    counted = [
        told.select(
            (F.col("tag") == _FAMILY).cast("bigint").alias("n"), nothing.alias("a"),
            ((F.col("tag") == _STATE) & F.col("issue")).alias("issue"),
        ),
        suggested.select(nothing.alias("n"), F.lit(1).cast("bigint").alias("a"), F.lit(False).alias("issue")),
    ]
    totals = reduce(DataFrame.unionByName, counted).agg(
        F.sum("n").alias("n"), F.sum("a").alias("actions"), F.bool_or("issue").alias("issues")
    )
    intro_lines = F.when(
        F.col("issues"),
        F.array(F.lit(""), fill(X.REPORT_REGRESSIONS, count=F.col("n"))),
    ).otherwise(F.array(F.lit(""), F.lit(X.REPORT_CLEAN)))
    intro = _section(
        totals.select(F.posexplode(intro_lines).alias("pos", "line")),
        1, nowhere, F.col("pos"), F.col("line"),
    )
    median, runs = F.col("baseline_median"), F.col("baseline_runs")
    basis = F.when(
        (median != 0) & (runs != 0),
        fill(X.REPORT_BASIS, m=fixed(median, 1), n=runs),
    ).otherwise(F.lit(""))
    body = _section(
        regressions,
        2,
        F.struct(
            F.lit(0).alias("list"), F.col("rank"), F.col("first_seen").alias("seen"),
            F.lit(0).alias("pos"),
        ).cast(_PLACE),
        F.lit(0),
        F.concat(
            fill(
                X.REPORT_REGRESSION,
                family=F.col("job_id"),
                run=F.coalesce(F.nullif(F.col("run_identifier"), F.lit("")), F.col("job_id")),
                cluster=F.col("cluster_name"),
                message=F.col("message"),
            ),
            basis,
        ),
    )
    actions_intro = _section(
        totals.where("issues").select(
            F.posexplode(F.array(F.lit(""), F.lit(X.REPORT_ACTIONS))).alias("pos", "line")
        ),
        3, nowhere, F.col("pos"), F.col("line"),
    )
    actions = _section(
        suggested,
        4,
        F.col("place").cast(_PLACE),
        F.lit(0),
        fill(X.REPORT_ACTION, family=F.col("job_id"), action=F.col("action")),
    )
    no_action = _section(
        totals.where("issues AND actions = 0").select(F.lit(X.REPORT_NO_ACTION).alias("line")),
        4, nowhere, F.lit(0), F.col("line"),
    )
    tail_intro = _section(
        any_run.select(
            F.posexplode(F.array(F.lit(""), F.lit(X.REPORT_HIGHLIGHTS))).alias("pos", "line")
        ),
        5, nowhere, F.col("pos"), F.col("line"),
    )
    duration = F.col("duration_seconds")
    shown = F.when(duration != 0, F.concat(fixed(duration, 1), F.lit("s"))).otherwise(F.lit("n/a"))
    first_line = fill(
        X.REPORT_RUN,
        run=F.coalesce(F.nullif(F.col("run_identifier"), F.lit("")), F.col("job_id")),
        kind=F.lit("SPARK"),
        state=F.col("job_state"),
        duration=shown,
    )
    usage = F.when(
        F.coalesce("vcore_text", "memory_text").isNotNull(),
        fill(
            X.REPORT_USAGE,
            v=F.col("vcore_text"),
            m=F.col("memory_text"),
        ),
    )
    tail = highlights(outcomes).select(
        _order().alias("seen"),
        F.posexplode(F.array_compact(F.array(first_line, usage))).alias("pos", "line"),
    )
    tail = _section(
        tail,
        6,
        F.struct(
            F.lit(0).alias("list"), F.lit(0).alias("rank"), F.col("seen"), F.lit(0).alias("pos")
        ).cast(_PLACE),
        F.col("pos"),
        F.col("line"),
    )
    lines = header
    for section in (intro, body, actions_intro, actions, no_action, tail_intro, tail):
        lines = lines.unionByName(section)
    return lines


def _ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", F.asc_nulls_first("place"), "pos")


def iter_lines(outcomes: DataFrame) -> Iterator[str]:
    """Report lines in order, fetched one partition at a time."""
    if outcomes.isEmpty():
        yield X.REPORT_EMPTY
        return
    for row in _ordered(report_lines(outcomes)).select("line").toLocalIterator():
        yield row["line"]


def write_report(outcomes: DataFrame, path: str) -> None:
    """The whole report as text files whose names sort in report order."""
    _ordered(report_lines(outcomes)).select("line").write.mode("overwrite").text(path)


def numbered_lines(outcomes: DataFrame) -> DataFrame:
    """Report lines with their number in the report."""
    return line_numbers(report_lines(outcomes), ["section", "place", "pos"]).select(
        "line_no", "line"
    )
