from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest

from runlens.params import Params, load_params
from runlens.plans.monitor import tables


def test_overrides_without_base():
    p = load_params(
        {"project_id": "demo-project", "region": "us-central1", "lookback_hours": 6, "dry_run": True}
    )
    assert (p.project_id, p.region, p.lookback_hours, p.dry_run) == ("demo-project", "us-central1", 6, True)
    assert p.run_state_dataset is None
    assert p.run_state_table == "cag_run_state"
    assert tables(p) == (f"{p.bq_dataset}.cag_run_state", f"{p.bq_dataset}.daily_facts")
    assert tables(replace(p, run_state_dataset="other"))[0] == "other.cag_run_state"


def test_defaults():
    p = Params("p", "r")
    end = datetime(2024, 1, 9)
    assert p.window(end) == (datetime(2024, 1, 8), end) and p.history_window(end) == (datetime(2024, 1, 2), end)
    assert p.max_eventlog_bytes is None and p.eventlog_prefix == "" and not p.dry_run


def test_overrides_win_over_base():
    base = {"project_id": "a", "region": "b", "lookback_hours": "12", "dry_run": "YES"}
    p = load_params({"region": "c", "baseline_days": None}, base)
    assert (p.project_id, p.region, p.lookback_hours, p.baseline_days, p.dry_run) == ("a", "c", 12, 7, True)


def test_environment_with_prefix():
    env = {"MON_PROJECT_ID": "a", "MON_REGION": "b", "MON_MAX_EVENTLOG_BYTES": "2048", "PATH": "/bin", "REGION": "no"}
    p = load_params(base=env, prefix="mon_")
    assert (p.project_id, p.region, p.max_eventlog_bytes) == ("a", "b", 2048)
    with pytest.raises(ValueError):
        load_params(base=env, prefix="other_")


def test_incomplete_base_needs_full_overrides():
    with pytest.raises(ValueError):
        load_params({"region": "c"}, {"project_id": "a"})
    with pytest.raises(ValueError):
        load_params()
    assert load_params({"project_id": "p", "region": "c"}, {"lookback_hours": 3}).lookback_hours == 24


def test_windows_are_utc():
    aware = datetime(2024, 1, 2, 2, tzinfo=timezone(timedelta(hours=2)))
    assert Params("p", "r").window(aware) == (datetime(2024, 1, 1), datetime(2024, 1, 2))
