"""The plans are the ones wanted: pushed filters, narrow scans, no cross joins, no Python rows."""

import re

import pytest

from checks import registry, views
from conftest import SF

BATCH = [n for n in registry.QUERIES if not n.startswith(("stream_", "gold_r", "table_", "work_order_append"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "CollectLimit"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", ["hourly_status_patterns", "line_efficiency"])
def test_time_filter_reaches_the_scan(spark, name):
    scans = re.findall(r"PushedFilters: \[(.*?)\]", plan_of(registry.QUERIES[name](spark, SF)))
    assert scans and all("GreaterThanOrEqual(ts," in s for s in scans)


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(registry.QUERIES["hourly_status_patterns"](spark, SF))
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<ts:timestamp_ntz,event_type:string>"]


@pytest.mark.parametrize("name, scans", [
    ("period_over_period", 1), ("work_order_status_counts", 1), ("current_machine_status", 1), ("executive_kpis", 2),
    ("estimated_oee", 2), ("exception_items", 2), ("latest_status", 1)])
def test_one_scan_per_table(spark, name, scans):
    initial = plan_of(registry.QUERIES[name](spark, SF))
    assert initial.count("FileScan parquet") == scans


@pytest.mark.parametrize("name", ["latest_status", "work_order_aging", "priority_analysis", "line_efficiency", "employee_workload"])
def test_raw_rows_meet_a_hash_aggregate_first(spark, name):
    """The aggregate next to the scan keeps numbers in its buffers, so no row is sorted before the shuffle."""
    plan = plan_of(registry.QUERIES[name](spark, SF))
    lines = [line for line in plan.splitlines() if "FileScan" in line or "Aggregate" in line]
    nearest = [lines[i - 1] for i, line in enumerate(lines) if "FileScan" in line and "orders.parquet" in line or "events.parquet" in line]
    assert all("HashAggregate" in line and "SortAggregate" not in line for line in nearest)


def test_no_window_over_a_line_or_without_a_key(spark):
    for name in ("floor_layout", "all_machines", "next_on_line", "machine_location", "live_floor", "exception_report"):
        plan = plan_of(registry.QUERIES[name](spark, SF))
        windows = [w for w in plan.splitlines() if re.search(r"Window .*\], \[(line|alert_type)#\d+\]", w)]
        assert all("_range#" in w for w in windows), name  # one row per range


def test_neighbours_come_from_ranges(spark, monkeypatch):
    """The rows that the window sorts are those of a range, not of a machine."""
    plan = plan_of(registry.QUERIES["machine_uptime_7days"](spark, SF))
    assert "[_range#" in plan and "events.parquet" not in plan


def test_view_has_the_times_of_the_table(spark):
    feed = views.machine_feed(spark, SF)
    assert dict(feed.dtypes)["datetime"] == "timestamp_ntz"
