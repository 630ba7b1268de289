"""Requests, defaults and constraints."""

from datetime import datetime

import pytest

from millwatch import schemas
from millwatch.operators import constraints
from millwatch.operators.ingest import ingest_work_orders, with_defaults

NOW = datetime(2024, 1, 31, 9, 30)
GOOD = '"machine_id":"V","issue_description":"leak","reporter_name":"Ann"'

CASES = {
    '{"issue_description":"leak","reporter_name":"Ann"}': "machine_id is required",
    '{"machine_id":"","reporter_name":""}': "machine_id is required",
    '{"machine_id":null}': "machine_id is required",
    '{"machine_id":"V","reporter_name":""}': "issue_description is required",
    '{"machine_id":"V","issue_description":"leak"}': "reporter_name is required",
    '{%s,"priority":"urgent"}' % GOOD: "priority is not allowed",
    '{%s,"priority":null}' % GOOD: "priority is not allowed",
    '{%s,"priority":""}' % GOOD: "priority is not allowed",
    '{%s,"assignee":"%s"}' % (GOOD, "x" * 101): "assignee is longer than 100",
    '{"machine_id":"%s","issue_description":"leak","reporter_name":"Ann"}' % ("v" * 101): "machine_id is longer than 100",
    '{"machine_id":0,"issue_description":"leak","reporter_name":"Ann"}': "machine_id is required",
    '{"machine_id":-0.0,"issue_description":"leak","reporter_name":"Ann"}': "machine_id is required",
    '{"machine_id":"V","issue_description":false,"reporter_name":"Ann"}': "issue_description is required",
    '{"machine_id":"V","issue_description":[],"reporter_name":"Ann"}': "issue_description is required",
    '{"machine_id":"V","issue_description":"leak","reporter_name":{}}': "reporter_name is required",
    '{"machine_id":"V", ': "request is not a JSON object",
    "[1]": "request is not a JSON object",
    "": "request is not a JSON object",
    None: "request is not a JSON object",
}


def test_rejections_name_the_first_error(spark):
    requests = spark.createDataFrame([(str(i), raw) for i, raw in enumerate(CASES)], "request_key string, raw string")
    accepted, rejected = ingest_work_orders(requests, NOW)
    assert accepted.count() == 0
    assert {r["raw"]: r["error"] for r in rejected.collect()} == CASES


def test_accepted_rows(spark):
    raws = ["{%s}" % GOOD, '{%s,"priority":"high","assignee":null}' % GOOD, '{%s,"assignee":"Bo Ray"}' % GOOD]
    requests = spark.createDataFrame(list(enumerate(raws)), "request_key bigint, raw string")
    accepted, rejected = ingest_work_orders(requests, NOW)
    assert rejected.count() == 0 and accepted.columns == schemas.WORK_ORDERS.fieldNames()
    got = accepted.collect()
    assert [(r["priority"], r["assignee"], r["status"]) for r in got] == [
        ("medium", "", "open"), ("high", "", "open"), ("medium", "Bo Ray", "open")]
    assert all(r["timestamp"] == r["created_at"] == NOW for r in got)
    assert all(r["id"].startswith("WO-20240131-") and len(r["id"]) == 44 for r in got) and len({r["id"] for r in got}) == 3
    assert [r["id"] for r in ingest_work_orders(requests, NOW)[0].collect()] == [r["id"] for r in got]


def test_values_that_only_look_falsy(spark):
    raws = ['{"machine_id":"0","issue_description":"false","reporter_name":"[]","assignee":"0"}',
            '{"machine_id":7,"issue_description":["a"],"reporter_name":true,"assignee":[]}']
    accepted, rejected = ingest_work_orders(spark.createDataFrame(list(enumerate(raws)), "request_key bigint, raw string"), NOW)
    assert rejected.count() == 0
    assert sorted((r["machine_id"], r["issue_description"], r["reporter_name"], r["assignee"]) for r in accepted.collect()) == [
        ("0", "false", "[]", "0"), ("7", '["a"]', "true", "")]


def test_repeated_ids_are_rejected(spark):
    raw = "{%s}" % GOOD
    other = raw.replace("leak", "noise")
    requests = spark.createDataFrame([(1, raw), (1, raw), (1, other), (2, raw), (2, "junk"), (None, raw)], "request_key bigint, raw string")
    accepted, rejected = ingest_work_orders(requests, NOW)
    assert accepted.count() == 2 and accepted.select("id").distinct().count() == 2
    assert sorted((str(r["request_key"]), r["error"]) for r in rejected.collect()) == [
        ("1", "id already exists"), ("1", "id already exists"), ("2", "request is not a JSON object"), ("None", "request has no key")]
    again, refused = ingest_work_orders(requests, NOW, existing=accepted)
    assert again.count() == 0 and refused.count() == 6


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", ["accepted", "rejected"])
def test_requests_are_not_broadcast(spark, part):
    """Both sides of the join on ids grow with the requests, whatever the planner makes of the parsed rows' size."""
    requests = spark.createDataFrame([(1, "{%s}" % GOOD)], "request_key bigint, raw string")
    accepted, rejected = ingest_work_orders(requests, NOW)
    plan = _plan({"accepted": accepted, "rejected": rejected}[part])
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_known_ids_are_not_broadcast(spark):
    """Known ids that come from parsed requests are as many as those, and taken for as small."""
    requests = spark.createDataFrame([(1, "{%s}" % GOOD)], "request_key bigint, raw string")
    accepted, _ = ingest_work_orders(requests, NOW)
    again, refused = ingest_work_orders(requests, NOW, existing=accepted)
    assert "Broadcast" not in _plan(again) and "Broadcast" not in _plan(refused)


def test_accepted_and_rejected_are_all_requests(spark):
    raws = [*CASES, "{%s}" % GOOD]
    requests = spark.createDataFrame(list(enumerate(raws)), "request_key bigint, raw string")
    accepted, rejected = ingest_work_orders(requests, NOW)
    assert accepted.count() + rejected.count() == len(raws)


def test_defaults_fill_missing_columns_and_nulls(spark):
    got = with_defaults(spark.createDataFrame([(1, None), (2, False)], "id int, active boolean"), NOW, active=True).collect()
    assert [(r["active"], r["created_at"]) for r in got] == [(True, NOW), (False, NOW)]


def _broken(df):
    return {(r["rule"], r["key"]): r["count"] for r in df.collect()}


def test_work_order_constraints(orders_of):
    wo = orders_of(
        dict(id="A"), dict(id="A"), dict(id=None), dict(id=None), dict(priority="urgent"), dict(priority=None),
        dict(status="paused"), dict(machine_id=None), dict(reporter_name="x" * 101), dict(id="i" * 51), dict(assignee=None))
    assert _broken(constraints.check_constraints(wo, constraints.WORK_ORDER_RULES)) == {
        ("id unique", "A"): 2, ("id not null", None): 2, ("priority allowed", None): 1, ("priority not null", None): 1,
        ("status allowed", None): 1, ("machine_id not null", None): 1, ("reporter_name length", None): 1, ("id length", None): 1}
    rows = constraints.violating_rows(wo, constraints.WORK_ORDER_RULES)
    assert rows.filter("id is null").count() == 2
    assert rows.count() == 10 and rows.columns == [*wo.columns, "broken_rules"]


def test_employee_constraints(spark):
    emp = spark.createDataFrame([
        (1, "A", "B", "a@x", None, True, None), (2, "C", "D", "a@x", None, True, None), (3, "E", "F", None, None, True, None),
        (4, None, "F", None, None, True, None), (4, "G", "H", "g@x", "d" * 101, True, None)], schemas.EMPLOYEES)
    assert _broken(constraints.check_constraints(emp, constraints.EMPLOYEE_RULES)) == {
        ("id unique", "4"): 2, ("email unique", "a@x"): 2, ("first_name not null", None): 1, ("department length", None): 1}


def test_a_sound_table_breaks_nothing(orders_of):
    wo = orders_of(dict(), dict(), dict(assignee=None))
    assert constraints.check_constraints(wo, constraints.WORK_ORDER_RULES).count() == 0
    assert constraints.violating_rows(wo, constraints.WORK_ORDER_RULES).count() == 0


@pytest.mark.parametrize("rules", [constraints.FEED_RULES, constraints.WORK_ORDER_RULES, constraints.EMPLOYEE_RULES])
def test_rules_fit_their_schema(rules):
    schema = {"machine_feed": schemas.FEED, "work_orders": schemas.WORK_ORDERS, "employees": schemas.EMPLOYEES}[rules.table]
    named = [rules.primary_key, *rules.unique, *rules.not_null, *rules.allowed, *rules.max_length]
    assert set(named) <= set(schema.fieldNames())
