"""Run parameters: one frozen dataclass, plus the precedence rule for loading it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import datetime, timedelta, timezone
from typing import Any

_TRUE_WORDS = {"1", "true", "yes"}
_INT_FIELDS = {"lookback_hours", "baseline_days", "max_eventlog_bytes", "block_rows", "broadcast_rows"}
_OPTIONAL_FIELDS = {"run_state_dataset", "eventlog_bucket"}


@dataclass(frozen=True)
class Thresholds:
    """Detector limits. The defaults are fixed values the results depend on."""

    runtime_warning: float = 1.5
    runtime_critical: float = 2.0
    straggler_warning: float = 3.0
    straggler_critical: float = 5.0
    cost_warning: float = 1.3
    cost_critical: float = 1.75
    utilization_low: float = 0.45
    utilization_high: float = 0.95


@dataclass(frozen=True)
class Params:
    project_id: str
    region: str
    lookback_hours: int = 24
    baseline_days: int = 7
    bq_dataset: str = "dataproc_monitoring"
    bq_table: str = "daily_facts"
    run_state_dataset: str | None = None
    run_state_table: str = "cag_run_state"
    eventlog_bucket: str | None = None
    eventlog_prefix: str = ""
    max_eventlog_bytes: int | None = None
    dry_run: bool = False
    thresholds: Thresholds = Thresholds()
    # Physical limits, not semantics: rows per sweep block and the largest
    # lookup table (in rows) that may be broadcast.
    block_rows: int = 65_536
    broadcast_rows: int = 200_000

    def window(self, as_of: datetime) -> tuple[datetime, datetime]:
        """The closed look-back window that ends at ``as_of``, as naive UTC."""
        end = naive_utc(as_of)
        return end - timedelta(hours=self.lookback_hours), end

    def history_window(self, as_of: datetime) -> tuple[datetime, datetime]:
        """The closed window that historical baselines are made of."""
        end = naive_utc(as_of)
        return end - timedelta(days=self.baseline_days), end


def naive_utc(moment: datetime) -> datetime:
    """Naive datetimes are UTC already; aware ones are converted."""
    if moment.tzinfo is None:
        return moment
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def _convert(name: str, value: Any) -> Any:
    if name in _INT_FIELDS:
        return int(value)
    if name == "dry_run":
        return str(value).lower() in _TRUE_WORDS
    if name in _OPTIONAL_FIELDS:
        return value or None
    if name == "thresholds":
        return value
    return str(value)


def load_params(
    overrides: Mapping[str, Any] | None = None,
    base: Mapping[str, Any] | None = None,
    *,
    prefix: str | None = None,
) -> Params:
    """Overrides win over ``base`` settings. ``base`` counts only when it names both project
    and region; else the overrides must name both themselves. With ``prefix``, ``base`` is a
    process environment: ``<prefix>REGION`` is the setting ``region``, whatever the case."""
    if prefix is not None:
        named = {k.upper(): v for k, v in (base or {}).items()}
        start = prefix.upper()
        base = {k.removeprefix(start).lower(): v for k, v in named.items() if k.startswith(start)}
    known = {f.name for f in fields(Params)}
    given = {k: v for k, v in (overrides or {}).items() if k in known and v is not None}
    defaults = {k: v for k, v in (base or {}).items() if k in known}
    complete = bool(defaults.get("project_id")) and bool(defaults.get("region"))
    merged = {**defaults, **given} if complete else given
    missing = [k for k in ("project_id", "region") if not merged.get(k)]
    if missing:
        raise ValueError(f"missing required settings: {', '.join(missing)}")
    converted = {k: _convert(k, v) for k, v in merged.items()}
    return replace(Params(converted["project_id"], converted["region"]), **converted)
