"""Ingest -> performance memory -> report, as functions that hand on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.clock import date_literal, literal_for
from runlens.operators import report as R
from runlens.operators.baseline import historical_baseline
from runlens.operators.detect import add_findings
from runlens.operators.facts import fact_rows, memory_summary, outcomes, outcomes_of_facts
from runlens.operators.profile import narrow, profile_runs
from runlens.operators.resolve import cold_baselines, resolve_baselines
from runlens.params import Params
from runlens.sources.event_logs import read_event_logs
from runlens.sources.history import append_facts, check_fact_table, scan_history
from runlens.sources.run_state import ingest_summary, scan_runs
from runlens.storage import pin


class Status(Enum):
    """How far a step came."""

    DONE = "done"
    NOT_INGESTED = "not_ingested"
    NO_RUNS = "no_runs"
    NO_FACTS = "no_facts"


@dataclass(frozen=True)
class Ingested:
    runs: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Memory:
    """Result of the second step. ``facts`` and ``outcomes`` are None when there was
    nothing to build from; ``status`` then says why."""

    facts: DataFrame | None
    outcomes: DataFrame | None
    summary: dict
    status: Status = Status.DONE


def ingest(run_state: DataFrame, params: Params, as_of: datetime, *, uid: str) -> Ingested:
    """Runs of the look-back window ending at ``as_of``, with their summary frame.

    ``uid`` names a unique key of the run-state table.
    """
    start, end = params.window(as_of)
    runs = scan_runs(run_state, start, end, keep=(uid,))
    return Ingested(runs, ingest_summary(runs, start, end))


@dataclass(frozen=True)
class Analysis:
    """Runs with baseline and findings. ``found`` is narrow and comes from a pinned
    profile; ``wide`` also has the documents, read again from the source, for the facts."""

    found: DataFrame
    wide: DataFrame


def analyse(
    runs: DataFrame, history: DataFrame, params: Params, as_of: datetime, *, uid: str
) -> Analysis:
    limit = {"broadcast_rows": params.broadcast_rows}
    baselines = pin(historical_baseline(scan_history(history, *params.history_window(as_of))))
    profiled = profile_runs(runs, uid=uid, limits=params.thresholds)
    kept = pin(narrow(profiled))
    running = cold_baselines(kept, baselines, block_rows=params.block_rows, **limit)

    def finish(frame: DataFrame) -> DataFrame:
        return add_findings(resolve_baselines(frame, baselines, running, **limit), params.thresholds)

    return Analysis(finish(kept), finish(profiled))


def build_memory(
    ingested: Ingested | None,
    history: DataFrame,
    params: Params,
    as_of: datetime,
    *,
    uid: str,
    target: str | None = None,
    as_path: bool = False,
) -> Memory:
    """Facts for all ingested runs, appended to ``target`` unless dry.

    The narrow outcome rows are pinned once and feed summary and report; the wide fact
    rows go straight from scan to sink. A table target is checked first, dry run or not.
    """
    nothing = {
        "persisted_rows": 0,
        "dry_run": params.dry_run,
        "has_anomalies": False,
        "unreadable_runs": 0,
    }
    if ingested is None:
        return Memory(None, None, nothing, Status.NOT_INGESTED)
    if ingested.runs.isEmpty():
        return Memory(None, None, nothing, Status.NO_RUNS)
    if target is not None and not as_path:
        check_fact_table(history.sparkSession, target)
    analysis = analyse(ingested.runs, history, params, as_of, uid=uid)
    kept = pin(outcomes(analysis.found))
    facts = fact_rows(analysis.wide, params, as_of)
    if target is not None:
        append_facts(facts, target, dry_run=params.dry_run, as_path=as_path)
    summary = memory_summary(kept, params.dry_run).first().asDict()
    return Memory(facts, kept, summary)


def event_logs(spark: SparkSession, ingested: Ingested, params: Params) -> DataFrame:
    """Event logs of the ingested runs' applications, where the settings name a location."""
    ids = ingested.runs.select("application_id").where("application_id IS NOT NULL")
    return read_event_logs(
        spark,
        params.eventlog_bucket,
        ids,
        prefix=params.eventlog_prefix,
        max_bytes=params.max_eventlog_bytes,
    )


def status_report(memory: Memory | None) -> Iterator[str]:
    """Report lines in order; only the status where there are no facts."""
    if memory is None or memory.outcomes is None:
        yield Status.NO_FACTS.value
        return
    yield from R.iter_lines(memory.outcomes)


def stored_outcomes(facts: DataFrame, start: datetime, end: datetime, **order) -> DataFrame:
    """Outcome rows of facts ingested in the closed window, pinned, for any report operator."""
    low, high = (literal_for(facts, "ingest_timestamp", m) for m in (start, end))
    days = F.col("ingest_date").between(date_literal(start.date()), date_literal(end.date()))
    return pin(outcomes_of_facts(facts.where(days & F.col("ingest_timestamp").between(low, high)), **order))


def tables(params: Params) -> tuple[str, str]:
    """Catalog names of the run states and of the facts. Run states are next to the facts
    unless the settings name a place of their own."""
    runs_in = params.run_state_dataset or params.bq_dataset
    return f"{runs_in}.{params.run_state_table}", f"{params.bq_dataset}.{params.bq_table}"


def run_once(
    spark: SparkSession, params: Params, as_of: datetime, *, uid: str, report_to: str | None = None
) -> tuple[Memory, Iterator[str]]:
    """All three steps over catalog tables. With ``report_to`` the report is written there by
    tasks; the returned lines come one partition at a time."""
    runs, facts = tables(params)
    ingested = ingest(spark.table(runs), params, as_of, uid=uid)
    memory = build_memory(
        ingested,
        spark.table(facts),
        params,
        as_of,
        uid=uid,
        target=facts,
    )
    if report_to is not None and memory.outcomes is not None:
        R.write_report(memory.outcomes, report_to)
    return memory, status_report(memory)
