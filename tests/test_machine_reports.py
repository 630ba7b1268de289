"""Hand-made readings for what the test tables do not show."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from checks import views
from conftest import SF
from millwatch.functions.machines import display_status, line_of, machine_icon, machine_type, short_name
from millwatch.operators.latest import latest_readings
from millwatch.plans import floor as floor_views
from millwatch.plans import kpi, machine
from millwatch.sources.floor import all_machines, configured_floor, floor_layout, machine_locations, next_on_line

NOW = datetime(2024, 1, 31, 12)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_latest_breaks_ties_and_puts_missing_times_first(feed_of):
    feed = feed_of(
        (1, "A", "operational", "valve", "2024-01-30 10:00"), (1, "A", "warning", "valve", "2024-01-30 10:00"),
        (2, "B", "down", "valve", "2024-01-30 10:00"), (2, "B", "operational", "valve", None),
        (3, None, "down", "valve", "2024-01-01 10:00"), (3, None, "warning", "valve", "2024-01-02 10:00"))
    assert rows(latest_readings(feed), "machine_name", "status", "datetime") == [
        ("A", "warning", datetime(2024, 1, 30, 10)), ("B", "operational", None), (None, "warning", datetime(2024, 1, 2, 10))]


def test_machine_with_two_types_counts_twice(feed_of):
    feed = feed_of((1, "X_01_01", "down", "valve", "2024-01-01 10:00"), (1, "X_01_01", "operational", "painter", "2024-01-02 10:00"))
    assert rows(machine.current_machine_status(feed, NOW), "production_line", "equipment_type", "status", "machine_count", "percentage") == [
        ("Line_1", "painter", "operational", 1, 50.0), ("Line_1", "valve", "operational", 1, 50.0)]


def test_uptime_intervals(feed_of):
    feed = feed_of(
        # before the window: neither counted nor used as a start
        (1, "A_01_01", "operational", "valve", "2024-01-23 23:59"),
        # exactly at the start of the window
        (1, "A_01_01", "operational", "valve", "2024-01-24 00:00"), (1, "A_01_01", "warning", "valve", "2024-01-24 06:00"),
        (1, "A_01_01", "operational", "valve", "2024-01-31 06:00"),
        # one reading, at this very moment: no time at all
        (2, "B_02_01", "down", "valve", "2024-01-31 12:00"),
        (3, "C_03_01", "down", "valve", "2024-01-31 02:00"))
    assert rows(machine.machine_uptime(feed, NOW), "machine_name", "uptime_percentage", "operational_hours", "downtime_hours") == [
        ("A_01_01", 6.67, 12.0, 168.0), ("B_02_01", None, 0.0, 0.0), ("C_03_01", 0.0, 0.0, 10.0)]


def test_incidents_need_operational_just_before(feed_of):
    feed = feed_of(
        (1, "A_01_01", "operational", "valve", "2024-01-10 00:00"), (1, "A_01_01", "down", "valve", "2024-01-10 01:00"),
        (1, "A_01_01", "operational", "valve", "2024-01-10 02:00"), (1, "A_01_01", "down", "valve", "2024-01-11 01:00"),
        (2, "B_01_01", "operational", "valve", "2024-01-10 00:00"), (2, "B_01_01", "warning", "valve", "2024-01-10 01:00"),
        (2, "B_01_01", "down", "valve", "2024-01-10 02:00"),
        # the operational reading lies before the window
        (3, "C_01_01", "operational", "valve", "2023-12-31 23:00"), (3, "C_01_01", "down", "valve", "2024-01-01 01:00"))
    assert rows(machine.problematic_machines(feed, NOW), "machine_name", "downtime_incidents",
                "days_with_issues", "first_incident", "last_incident") == [
        ("A_01_01", 2, 2, datetime(2024, 1, 10, 1), datetime(2024, 1, 11, 1))]


def test_status_change_kinds(feed_of):
    feed = feed_of(*[(1, "A_01_01", s, "valve", f"2024-01-30 0{i}:00") for i, s in enumerate(
        ["down", "warning", "operational", "down", "operational", "operational"])])
    assert rows(machine.machine_status_changes(feed, NOW), "status_hour", "previous_status", "status_change_type") == [
        (1, "down", "STABLE"), (2, "warning", "STABLE"), (3, "operational", "FAILURE"), (4, "down", "RECOVERY"),
        (5, "operational", "STABLE")]


def test_reports_from_shared_transitions_equal_the_single_ones(spark):
    feed = views.machine_feed(spark, SF)
    shared = machine.transitions(feed, views.AS_OF)
    pairs = [
        (machine.uptime_from_transitions(shared, views.AS_OF), machine.machine_uptime(feed, views.AS_OF)),
        (machine.problems_from_transitions(shared, views.AS_OF), machine.problematic_machines(feed, views.AS_OF)),
        (machine.changes_from_transitions(shared, views.AS_OF), machine.machine_status_changes(feed, views.AS_OF)),
    ]
    for one, other in pairs:
        assert rows(one, *other.columns) == rows(other, *other.columns)


def test_uptime_and_downtime_add_up(spark):
    feed = views.machine_feed(spark, SF)
    first = feed.filter("datetime >= timestamp_ntz'2024-01-24'").groupBy("machine_name").agg(F.min("datetime").alias("first"))
    joined = machine.machine_uptime(feed, views.AS_OF).join(first, "machine_name")
    for r in joined.collect():
        hours = (views.AS_OF - r["first"]).total_seconds() / 3600
        assert abs(r["operational_hours"] + r["downtime_hours"] - hours) < 0.011


def test_machines_down(feed_of, orders_of):
    feed = feed_of(
        (1, "exact", "down", "valve", "2024-01-31 08:00"),         # exactly four hours: not over
        (2, "long", "down", "valve", "2024-01-31 07:59"), (2, "long", "warning", "valve", "2024-01-31 09:00"),
        (3, "back", "down", "valve", "2024-01-31 01:00"), (3, "back", "operational", "valve", "2024-01-31 02:00"),
        (4, "again", "operational", "valve", "2024-01-31 02:00"), (4, "again", "down", "valve", "2024-01-31 03:00"),
        (5, "tie", "down", "valve", "2024-01-31 03:00"), (5, "tie", "operational", "valve", "2024-01-31 03:00"),
        (6, "old", "down", "valve", "2024-01-29 23:00"), (7, None, "down", "valve", "2024-01-31 01:00"))
    assert rows(kpi.machines_down(feed, NOW), "machine_name") == [("again",), ("long",), ("tie",)]
    report = {r["alert_type"]: (r["count"], r["details"]) for r in
              kpi.exception_report(orders_of(dict(status="completed")), feed, NOW).collect()}
    assert report == {
        "Machines Down Over 4h": (3, "again, long, tie"), "Critical Open Work Orders": (0, None),
        "Overdue High Priority Orders": (0, None), "Unassigned Orders Over 24h": (0, None)}


def test_kpis_without_recent_readings(feed_of, orders_of):
    feed = feed_of((1, "A", "down", "valve", "2024-01-01 10:00"))
    values = {r["metric_name"]: r["current_value"] for r in
              kpi.executive_kpis(feed, orders_of(dict(status="cancelled")), NOW).collect()}
    assert values == {"Total Machines": 0.0, "Current Uptime %": None, "Open Orders": 0.0, "Critical Orders": 0.0,
                      "Avg Resolution Time (hours)": None}


@pytest.mark.parametrize("name, line, strict", [
    ("Source_Sorter_01_01", "Line_1", "Line_1"), ("Injection_Molder_02_01", "Line_2", "Line_2"),
    ("Valve_04_01", "Unknown", "Line_4"), ("X_101_02", "Line_1", "Unknown"), ("Press", "Unknown", "Unknown")])
def test_line(spark, name, line, strict):
    got = spark.createDataFrame([(name,)], "n string").select(line_of(F.col("n")), line_of(F.col("n"), strict=True)).first()
    assert tuple(got)[1] == strict
    # the underscore of LIKE is any character: a name may match by other digits
    assert tuple(got)[0] == line


@pytest.mark.parametrize("name, short, kind, icon", [
    ("Source_Sorter_01_01", "S_S_01_01", "sorter", "sorter.png"), ("Robotic_Arm_01_02", "R_A_01_02", "robotic_arm", "robotic_arm.png"),
    ("Press", "Press", "sorter", "sorter.png"), ("A_01", "A_01", "sorter", "sorter.png"),
    ("Drill_01_01", "D_01_01", "sorter", "sorter.png"), ("VALVE_9_9", "V_9_9", "valve", "valve_icon.png"),
    ("a__b_1_2", "A__B_1_2", "sorter", "sorter.png")])
def test_names(spark, name, short, kind, icon):
    k = machine_type(F.col("n"))
    got = spark.createDataFrame([(name,)], "n string").select(short_name(F.col("n")), k, machine_icon(k)).first()
    assert tuple(got) == (short, kind, icon)


@pytest.mark.parametrize("text, shown", [
    ("Running", "operational"), ("OPERATIONAL", "operational"), ("operational-ish", "unknown"), ("CAUTION", "warning"),
    ("warn", "warning"), ("Fault 12", "down"), ("failed", "down"), ("error", "down"), ("idle", "unknown"), (None, "unknown"), ("", "unknown")])
def test_display_status(spark, text, shown):
    assert spark.createDataFrame([(text,)], "s string").select(display_status(F.col("s"))).first()[0] == shown


def test_configured_floor(spark):
    floor = configured_floor(spark)
    layout = floor_layout(floor).collect()
    assert len(layout) == 30 and {r["total_machines"] for r in layout} == {30}
    assert {r["line"]: r["machine_count"] for r in layout} == {
        "Transmission Line": 9, "Engine Line": 7, "Exterior Line": 9, "Interior Line": 5}
    assert [r["name"] for r in all_machines(floor).collect()][:3] == [
        "Source_Sorter_01_01", "Robotic_Arm_01_01", "Injection_Molder_01_01"]
    flow = {r["name"]: r["next_name"] for r in next_on_line(floor).collect()}
    assert flow["Valve_02_01"] == "Injection_Molder_02_02" and flow["Sorter_04_01"] is None


def test_locations(spark):
    names = spark.createDataFrame([("Painter_03_01",), ("Nowhere",), (None,)], "machine_name string")
    assert rows(machine_locations(names, configured_floor(spark)), "machine_name", "line", "position", "total_in_line") == [
        ("Nowhere", None, None, None), ("Painter_03_01", "Exterior Line", 6, 9), (None, None, None, None)]


def test_live_floor_and_candidates(spark, feed_of, orders_of):
    feed = feed_of(
        (1, "Valve_01_01", "Fault 3", "valve", "2024-01-30 10:00"), (2, "Sorter_01_01", "down", "sorter", "2024-01-30 10:00"),
        (3, "Ghost_01_01", "down", "valve", "2024-01-30 10:00"))
    view = floor_views.live_floor(configured_floor(spark), latest_readings(feed))
    shown = {r["name"]: r["status"] for r in view.collect()}
    assert len(shown) == 30 and shown["Valve_01_01"] == "down" and shown["Painter_01_02"] == "unknown"
    assert rows(floor_views.work_order_candidates(view), "name") == [("Sorter_01_01",), ("Valve_01_01",)]
    assert rows(floor_views.work_order_candidates(view, orders_of(dict(machine_id="Valve_01_01"))), "name") == [("Sorter_01_01",)]


def test_latest_status_json_keeps_nulls(feed_of):
    feed = feed_of((1, "A", None, "valve", None), (2, "B", "down", "valve", "2024-01-30 10:00:00.250000"))
    assert rows(floor_views.latest_status_json(feed), "key", "value") == [
        ("A", '{"status":null,"type":"valve","datetime":null}'),
        ("B", '{"status":"down","type":"valve","datetime":"2024-01-30T10:00:00.250000"}')]


def test_hourly_patterns_share(feed_of):
    feed = feed_of(*[(1, "A", s, "valve", f"2024-01-30 05:0{i}") for i, s in enumerate(["down", "operational", "warning"])])
    r = machine.hourly_status_patterns(feed, NOW).first()
    assert (r["hour_of_day"], r["downtime_percentage"], r["total_readings"]) == (5, 33.33, 3)
    assert date(2024, 1, 30) == feed.select(F.to_date("datetime")).first()[0]
