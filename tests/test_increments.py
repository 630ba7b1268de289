"""Refreshes from parts by day against the full refresh."""

from datetime import date, datetime

import pytest

from checks.views import AS_OF
from millwatch import schemas
from millwatch.operators.latest import newest_variants
from millwatch.plans import gold, increments
from millwatch.session import scratch_dir
from millwatch.sources import tables

FIRST = [
    (1, "A_01_01", "operational", "valve", "2024-01-10 09:00"), (1, "A_01_01", "down", "valve", "2024-01-10 10:00"),
    (1, "A_01_01", "operational", "valve", "2024-01-27 23:59:59"), (1, "A_01_01", "down", "sorter", "2024-01-29 00:00"),
    (1, "A_01_01", "down", "sorter", "2024-01-29 00:00"), (1, "A_01_01", None, "sorter", "2024-01-29 08:00"),
    (2, "B_01_01", "operational", "valve", "2024-01-30 10:00"), (2, "B_01_01", "down", "valve", "2024-01-30 11:00"),
    (3, None, "operational", None, "2024-01-28 10:00"), (3, None, "down", None, "2024-01-30 10:00"),
    (4, "C_01_01", "down", "valve", None), (5, "D_01_01", "operational", "valve", "2023-11-01 10:00"),
]
# A warning that takes an incident away, one between two days, a reading of a day without any, one of a new machine.
LATE = [
    (2, "B_01_01", "warning", "valve", "2024-01-30 10:30"), (1, "A_01_01", "operational", "valve", "2024-01-28 12:00"),
    (6, "E_01_01", "operational", "valve", "2024-01-12 00:00"), (6, "E_01_01", "down", "valve", "2024-01-12 23:59:59"),
]
CHANGED = [date(2024, 1, 12), date(2024, 1, 28), date(2024, 1, 30)]


def rows_of(spark, root, name):
    return sorted(map(repr, gold.read_gold(spark, root, name).collect()))


@pytest.fixture(scope="module")
def refreshed(spark):
    lake, orders = scratch_dir(spark, "lake"), spark.createDataFrame([], schemas.WORK_ORDERS)
    parts, roots, feed, days = f"{lake}/parts", [], None, []
    for batch_id, rows in enumerate((FIRST, LATE, [])):
        new = spark.createDataFrame([(*r[:4], r[4] and datetime.fromisoformat(r[4])) for r in rows], schemas.FEED)
        feed = new if feed is None else feed.unionByName(new)
        tables.append_history(new, f"{lake}/history", batch_id)
        history = tables.read_history(spark, f"{lake}/history")
        days.append(increments.update_parts(spark, history, parts))
        step = (f"{lake}/gold-{batch_id}", f"{lake}/full-{batch_id}")
        increments.refresh_gold_incremental(spark, history, orders, AS_OF, step[0], parts, newest_variants(feed))
        gold.refresh_gold(spark, feed, orders, AS_OF, step[1])
        roots.append(step)
    return days, roots


@pytest.mark.parametrize("name", gold.GOLD_TABLES)
def test_same_rows_as_a_full_refresh_after_each_batch(spark, refreshed, name):
    for mine, full in refreshed[1]:
        assert rows_of(spark, mine, name) == rows_of(spark, full, name)


def test_only_changed_days_are_worked_out_again(refreshed):
    assert refreshed[0][1:] == [CHANGED, []] and len(refreshed[0][0]) == 6


def test_a_refresh_reads_no_unchanged_day(spark, refreshed):
    """The plan of the changed days prunes the history to them."""
    path = scratch_dir(spark, "history")
    rows = [(*r[:4], r[4] and datetime.fromisoformat(r[4])) for r in FIRST]
    tables.append_history(spark.createDataFrame(rows, schemas.FEED), path, 0)
    plan = increments.changed_rows(tables.read_history(spark, path), CHANGED)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert all(str(day) in filters or str((day - date(1970, 1, 1)).days) in filters for day in CHANGED)


def test_no_history_at_all(spark):
    lake, orders = scratch_dir(spark, "lake"), spark.createDataFrame([], schemas.WORK_ORDERS)
    feed = spark.createDataFrame([], schemas.HISTORY)
    increments.refresh_gold_incremental(spark, feed, orders, AS_OF, f"{lake}/gold", f"{lake}/parts", newest_variants(feed))
    assert rows_of(spark, f"{lake}/gold", "machine_uptime_7days") == []
