"""Hand-made work orders: edges of buckets, periods, assignees and namesakes."""

from datetime import datetime

import pytest

from millwatch import schemas
from millwatch.plans import kpi, orders, people, tiles
from millwatch.sources.tables import empty_as_null, squeeze_spaces

NOW = datetime(2024, 1, 31)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def staff(spark, *people_rows):
    return spark.createDataFrame(
        [(i, first, last, None, dept, active, None) for i, first, last, dept, active in people_rows], schemas.EMPLOYEES)


def test_age_buckets_at_their_edges(orders_of):
    wo = orders_of(*[dict(timestamp=t, machine_id=m, priority=p) for t, m, p in [
        ("2024-01-30 00:00:01", "m1", "low"), ("2024-01-30 00:00", "m3", "high"), ("2024-01-28 00:00", "m4", "low"),
        ("2024-01-24 00:00", "m5", "low"), ("2024-01-01 00:00", "m6", "low"), ("2024-01-30 00:00", "m2", "critical")]])
    got = [tuple(r) for r in orders.work_order_aging(wo, NOW).select(
        "age_bucket", "order_count", "example_machine", "min_priority", "max_priority").collect()]
    assert got == [
        ("Less than 1 day", 1, "m1", "low", "low"), ("1-3 days", 2, "m2", "critical", "high"), ("3-7 days", 1, "m4", "low", "low"),
        ("1-4 weeks", 1, "m5", "low", "low"), ("Over 1 month", 1, "m6", "low", "low")]


def test_trend_skips_missing_days_and_marks_volume(orders_of):
    days = ["2024-01-02"] * 10 + ["2024-01-05"] * 10 + ["2024-01-20"] * 30 + ["2024-01-21"]
    wo = orders_of(*[dict(timestamp=f"{d} 08:00") for d in days])
    assert rows(orders.work_order_trends(wo, NOW), "daily_count", "seven_day_moving_avg", "volume_indicator") == [
        (1, 12.75, "Low"), (10, 10.0, "Normal"), (10, 10.0, "Normal"), (30, 16.67, "High")]


def test_trend_threshold_is_exact(orders_of):
    # 12 against an average of 10 is exactly 1.2 times: not High
    wo = orders_of(*[dict(timestamp=f"{d} 08:00") for d in ["2024-01-02"] * 8 + ["2024-01-03"] * 12])
    assert rows(orders.work_order_trends(wo, NOW), "daily_count", "volume_indicator") == [(12, "Normal"), (8, "Normal")]


def test_period_change_over_an_empty_week(orders_of):
    wo = orders_of(dict(timestamp="2024-01-30 00:00", created_at="2024-01-30 03:00", status="completed"))
    assert rows(orders.period_over_period(wo, NOW), "metric", "current_period", "previous_period", "percent_change") == [
        ("Avg Resolution Hours", 3.0, None, None), ("Critical Orders", 0.0, 0.0, None),
        ("Orders Completed", 1.0, 0.0, None), ("Work Orders Created", 1.0, 0.0, None)]


def test_period_change_rounds_away_from_zero(orders_of):
    old, new = "2024-01-18 00:00", "2024-01-28 00:00"
    wo = orders_of(*[dict(timestamp=old)] * 800, *[dict(timestamp=new)] * 799,
                   dict(timestamp="2024-01-18 00:00", created_at="2024-01-18 03:00", status="completed"),
                   dict(timestamp="2024-01-28 00:00", created_at="2024-01-28 02:00", status="completed"))
    got = {r["metric"]: r["percent_change"] for r in orders.period_over_period(wo, NOW).collect()}
    assert got["Work Orders Created"] == -0.12 and got["Avg Resolution Hours"] == -33.33


def test_reports_without_orders(orders_of):
    empty = orders_of(dict()).filter("false")
    assert orders.work_order_status_summary(empty, NOW).count() == 0
    assert [r["current_period"] for r in orders.period_over_period(empty, NOW).collect()] == [0.0, 0.0, None, 0.0]
    assert orders.work_order_status_counts(empty).first().asDict() == {"open": 0, "in_progress": 0, "completed": 0, "total": 0}


def test_empty_assignee_is_not_null(orders_of):
    wo = orders_of(dict(assignee=None), dict(assignee=""), dict(assignee="Ann Lee"), dict(assignee="Ann Lee"))
    day = orders.daily_operations(wo, NOW).first()
    assert (day["assigned_orders"], day["unassigned_orders"], day["active_assignees"]) == (3, 1, 2)
    assert rows(orders.work_order_list(wo), "assignee") == [("Ann Lee",), ("Ann Lee",), ("Unassigned",), ("Unassigned",)]
    assert orders.daily_operations(empty_as_null(wo, "assignee"), NOW).first()["unassigned_orders"] == 2


def test_status_counts_leave_cancelled_out_but_in_total(orders_of):
    wo = orders_of(*[dict(status=s) for s in ["open", "in_progress", "In Progress", "completed", "cancelled"]])
    assert orders.work_order_status_counts(wo).first().asDict() == {"open": 1, "in_progress": 2, "completed": 1, "total": 5}


@pytest.mark.parametrize("choice, found", [
    (dict(), 3), (dict(status="in-progress"), 1), (dict(status="open", priority="high"), 1), (dict(machine="VALVE"), 2),
    (dict(assignee="Unassigned"), 1), (dict(status="open", machine="painter", assignee="Ann Lee"), 0)])
def test_order_filter(orders_of, choice, found):
    wo = orders.work_order_list(orders_of(
        dict(status="open", priority="high"), dict(status="in_progress"), dict(machine_id="Painter_01_02", assignee="")))
    assert orders.work_order_filter(wo, **choice).count() == found


def test_display_cuts_long_texts(orders_of):
    wo = orders_of(dict(issue_description="x" * 60), dict(issue_description="y" * 61))
    assert rows(orders.work_order_display(wo), "issue", "created") == [
        ("x" * 60, "2024-01-30 00:00"), ("y" * 60 + "...", "2024-01-30 00:00")]


def test_top_machines_break_ties_by_critical_then_name(orders_of):
    wo = orders_of(dict(machine_id="b"), dict(machine_id="a"), dict(machine_id="c", priority="critical"), dict(machine_id="d"), dict(machine_id="d"))
    assert [r["machine_id"] for r in orders.machine_order_frequency(wo, NOW, top=3).collect()] == ["d", "c", "a"]


def test_namesakes_share_orders_and_departments_count_them_twice(spark, orders_of):
    emp = staff(spark, (1, "Ann", "Lee", "Ops", True), (2, "Ann", "Lee", "Ops", True), (3, "Bo", "Ray", "Lab", True),
                (4, "Cy", "Moe", "Lab", False), (5, "Di", "Fox", None, True))
    wo = orders_of(dict(status="completed", priority="critical", created_at="2024-01-30 06:00"), dict(), dict(assignee="Cy Moe"))
    assert rows(people.employee_workload(emp, wo), "employee_name", "total_assigned", "completed_assignments", "avg_completion_hours") == [
        ("Ann Lee", 2, 1, 6.0), ("Ann Lee", 2, 1, 6.0), ("Bo Ray", 0, 0, None), ("Di Fox", 0, 0, None)]
    got = [tuple(r) for r in people.department_performance(emp, wo).select(
        "department", "employee_count", "total_work_orders", "completion_rate", "avg_resolution_hours", "critical_resolved").collect()]
    # no orders sorts first
    assert got == [("Lab", 1, 0, None, None, 0), ("Unassigned", 1, 0, None, None, 0), ("Ops", 2, 4, 50.0, 6.0, 2)]


def test_response_time_needs_three_and_keeps_the_empty_name(orders_of):
    one = dict(status="in_progress", assignee="", created_at="2024-01-30 01:00")
    wo = orders_of(one, one, {**one, "priority": "high", "created_at": "2024-01-30 02:30"},
                   dict(status="completed"), dict(status="completed"), dict(status="open"))
    got = people.employee_response_time(wo).collect()
    assert len(got) == 1 and got[0]["assignee"] == ""
    assert (got[0]["avg_response_hours"], got[0]["avg_high_response_hours"], got[0]["avg_normal_response_hours"],
            got[0]["avg_critical_response_hours"], got[0]["slowest_response_hours"]) == (1.5, 2.5, 1.0, None, 2.5)


def test_alert_edges(orders_of, feed_of):
    wo = orders_of(
        dict(priority="high", timestamp="2024-01-29 00:00"),                             # exactly 48 hours
        dict(priority="high", timestamp="2024-01-28 23:59", assignee=None, status="in_progress"),
        dict(assignee=None, timestamp="2024-01-29 00:00"), dict(assignee="", timestamp="2024-01-01 00:00"),
        dict(priority="critical", timestamp="2024-01-30 20:57"))
    got = {r["alert_type"]: (r["count"], r["details"]) for r in kpi.exception_report(wo, feed_of((1, "A", "down", "v", None)), NOW).collect()}
    assert got["Overdue High Priority Orders"] == (1, "WO-1 (Valve_01_01 - )")
    assert got["Unassigned Orders Over 24h"] == (1, "WO-2 (Valve_01_01 - low)")
    assert got["Critical Open Work Orders"] == (1, "WO-4 (Valve_01_01 - 3.1h old)")


def test_long_alerts_are_paged_whole(orders_of, feed_of):
    wo = orders_of(*[dict(priority="critical")] * 57)
    report = kpi.exception_report(wo, feed_of((1, "A", "down", "v", None)), NOW, page=10).collect()
    assert len({(r["alert_type"], r["page"]) for r in report}) == len(report) == 6 + 3
    pages = sorted((r for r in report if r["alert_type"] == "Critical Open Work Orders"), key=lambda r: r["page"])
    assert [(r["page"], r["pages"], r["count"]) for r in pages] == [(i, 6, 57) for i in range(1, 7)]
    items = [i for r in pages for i in r["details"].split(", ")]
    assert items == sorted(items) and sorted(i.split(" ")[0] for i in items) == sorted(f"WO-{i}" for i in range(57))
    assert [len(r["details"].split(", ")) for r in pages] == [10] * 5 + [7]
    quiet = [r for r in report if r["alert_type"] != "Critical Open Work Orders"]
    assert all((r["page"], r["pages"], r["count"], r["details"]) == (1, 1, 0, None) for r in quiet)


def test_copies_of_an_alert_fill_pages(orders_of, feed_of):
    wo = orders_of(*[dict(id="WO-hot", priority="critical")] * 90, *[dict(priority="critical")] * 10)
    report = kpi.exception_report(wo, feed_of((1, "A", "down", "v", None)), NOW, page=10).collect()
    pages = [r["details"].split(", ") for r in report if r["alert_type"] == "Critical Open Work Orders"]
    assert sum(map(len, pages)) == 100 and sum(i.startswith("WO-hot ") for p in pages for i in p) == 90
    assert len(pages) == 10 and {len(p) for p in pages} == {10}


def test_oee_of_a_machine_without_orders(feed_of, orders_of):
    feed = feed_of((1, "A_01_01", "operational", "valve", "2024-01-30 10:00"), (1, "A_01_01", "down", "valve", "2024-01-30 11:00"))
    r = kpi.estimated_oee(feed, orders_of(dict(machine_id="other")), NOW).first()
    assert (r["availability_percent"], r["work_orders_7days"], r["avg_resolution_hours"], r["estimated_oee_percent"]) == (50.0, 0, 0.0, 0.4)


def test_department_text_repair(spark):
    emp = staff(spark, (1, "A", "B", "Quality \n  Control", True))
    assert squeeze_spaces(emp, "department").first()["department"] == "Quality Control"


def test_tile_filter(spark):
    uptime = spark.createDataFrame([("L", "a", 50.0, 1.25, 2.5), ("L", "b", 70.0, 2.0, 0.5)],
                                   "production_line string, machine_name string, uptime_percentage double, "
                                   "operational_hours double, downtime_hours double")
    assert tiles.average_uptime(uptime).first()[0] == 60.0 and tiles.average_uptime(uptime, "b").first()[0] == 70.0
    assert tiles.total_downtime(uptime, "a").first()[0] == 2.5
    assert rows(tiles.machine_filter_values(uptime, "a"), "machine_name", "associated") == [("a", 1), ("b", 0)]
    assert tiles.average_uptime(uptime, "none").first()[0] is None
