"""Every registered query: what Spark runs and the SQL it is compared with."""

from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle, views
from checks.views import AS_OF
from millwatch import schemas
from millwatch.functions.machines import display_status, line_of, machine_icon, machine_type, short_name
from millwatch.functions.times import at, day_start
from millwatch.operators import changes, constraints, ingest
from millwatch.operators.latest import latest_readings
from millwatch.plans import floor as floor_views
from millwatch.plans import gold, increments, kpi, machine, orders, people, tiles
from millwatch.session import exists, scratch_dir
from millwatch.sources import clustered, floor, tables
from millwatch.sources.change_feed import read_change_stream
from millwatch.streaming import jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]


def _feed(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: plan(views.machine_feed(spark, sf))


def _orders(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: plan(views.work_orders(spark, sf))


def _both(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: plan(views.machine_feed(spark, sf), views.work_orders(spark, sf))


def _people(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: plan(views.employees(spark, sf), views.work_orders(spark, sf))


# -- gold tables and reports ----------------------------------------------------------------------


_INPUTS = {"feed": views.machine_feed, "work_orders": views.work_orders}


def _gold(name: str) -> Query:
    inputs, plan = gold.GOLD_TABLES[name]
    return lambda spark, sf: plan(*[_INPUTS[i](spark, sf) for i in inputs], AS_OF)


def _gold_roundtrip(name: str) -> Query:
    """Write the gold table and read it back."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = scratch_dir(spark, "gold")
        gold.write_gold(_gold(name)(spark, sf), root, name)
        return gold.read_gold(spark, root, name, "single")
    return run


# (application, test tables, gold table) -> where it is stored: tiles read stored tables, as a dashboard does.
_STORED: dict[tuple[str, str, str], str] = {}


def _tile(name: str, tile: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, name)
        if key not in _STORED or not exists(spark, _STORED[key]):  # scratch may have been cleared in between
            _STORED[key] = scratch_dir(spark, "gold")
            gold.write_gold(_gold(name)(spark, sf), _STORED[key], name)
        return tile(gold.read_gold(spark, _STORED[key], name, "single"))
    return run


def _gold_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Refresh all gold tables together; every row of each, as text."""
    root = scratch_dir(spark, "gold")
    gold.refresh_gold(spark, views.machine_feed(spark, sf), views.work_orders(spark, sf), AS_OF, root)
    return _gold_rows(spark, root)


def _gold_refresh_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of history, the second with readings that come late for days of the first, and a refresh after each."""
    root, lake = scratch_dir(spark, "gold"), scratch_dir(spark, "lake")
    for batch_id, part in enumerate(_late_parts(views.machine_feed(spark, sf))):
        tables.append_history(part, f"{lake}/history", batch_id)
        tables.append_variants(part, f"{lake}/variants", batch_id)
        increments.refresh_gold_incremental(
            spark, tables.read_history(spark, f"{lake}/history"), views.work_orders(spark, sf), AS_OF, root, f"{lake}/parts",
            tables.read_variants(spark, f"{lake}/variants"))
    return _gold_rows(spark, root)


def _gold_rows(spark: SparkSession, root: str) -> DataFrame:
    texts = [
        gold.read_gold(spark, root, name).select(F.lit(name).alias("table_name"), F.expr(views.row_text(schema)).alias("row"))
        for name, schema in schemas.GOLD.items()
    ]
    return reduce(DataFrame.unionByName, texts)


def _table_roundtrip(view: Query, read: Query) -> Query:
    """Write a base table and read it back with its fixed schema."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_dir(spark, "table")
        view(spark, sf).write.parquet(path)
        return read(spark, path)
    return run


def _employees_with_time(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.with_defaults(views.employees(spark, sf), AS_OF)


SOURCES: dict[str, Query] = {
    "table_machine_feed": _table_roundtrip(views.machine_feed, tables.read_feed),
    "table_work_orders": _table_roundtrip(views.work_orders, tables.read_work_orders),
    "table_employees": _table_roundtrip(_employees_with_time, tables.read_employees),
}

REPORTS: dict[str, Query] = {
    "line_efficiency": _feed(lambda f: machine.line_efficiency(f, AS_OF)),
    "priority_analysis": _orders(lambda w: orders.priority_analysis(w, AS_OF)),
    "machine_order_frequency": _orders(lambda w: orders.machine_order_frequency(w, AS_OF)),
    "work_order_aging": _orders(lambda w: orders.work_order_aging(w, AS_OF)),
    "daily_operations": _orders(lambda w: orders.daily_operations(w, AS_OF)),
    "period_over_period": _orders(lambda w: orders.period_over_period(w, AS_OF)),
    "employee_workload": _people(people.employee_workload),
    "department_performance": _people(people.department_performance),
    "employee_response_time": _orders(people.employee_response_time),
    "estimated_oee": _both(lambda f, w: kpi.estimated_oee(f, w, AS_OF)),
    "exception_report": _both(lambda f, w: kpi.exception_report(w, f, AS_OF)),
    "exception_items": _both(lambda f, w: kpi.exception_items(w, f, AS_OF)),
}

TILES: dict[str, Query] = {
    "tile_equipment_distribution": _tile("current_machine_status", tiles.equipment_distribution),
    "tile_average_uptime": _tile("machine_uptime_7days", tiles.average_uptime),
    "tile_operational_hours_by_machine": _tile("machine_uptime_7days", tiles.operational_hours_by_machine),
    "tile_uptime_by_line": _tile("machine_uptime_7days", tiles.uptime_by_line),
    "tile_incident_count": _tile("problematic_machines_30days", tiles.incident_count),
    "tile_machine_count": _tile("machine_uptime_7days", tiles.machine_count),
    "tile_open_order_count": _tile("work_order_status_summary", tiles.open_order_count),
    "tile_total_downtime": _tile("machine_uptime_7days", tiles.total_downtime),
    "tile_downtime_hours_by_machine": _tile("machine_uptime_7days", tiles.downtime_hours_by_machine),
    "tile_machine_filter": _tile("machine_uptime_7days", tiles.machine_filter_values),
    "tile_machine_filter_selected": _tile(
        "machine_uptime_7days", lambda uptime: tiles.machine_filter_values(uptime, views.SELECTED_MACHINE)),
}

# -- floor and application queries ----------------------------------------------------------------


def _live(feed: DataFrame) -> DataFrame:
    return floor_views.live_floor(floor.floor_of_feed(feed), latest_readings(feed))


def _machine_types(feed: DataFrame) -> DataFrame:
    kind = machine_type(F.col("machine_name"))
    return feed.select("machine_id", "machine_name", "datetime", kind.alias("machine_type"), machine_icon(kind).alias("icon"))


def _per_machine(feed: DataFrame, **columns) -> DataFrame:
    counted = feed.groupBy("machine_name").agg(F.count(F.lit(1)).alias("readings"))
    return counted.select("machine_name", *[c.alias(name) for name, c in columns.items()], "readings")


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("status"))
    texts = raw.unionByName(views.machine_feed(spark, sf).select("status"))
    return texts.groupBy("status").agg(F.count(F.lit(1)).alias("readings")) \
        .select("status", display_status(F.col("status")).alias("display_status"), "readings")


FLOOR: dict[str, Query] = {
    "floor_layout": _feed(lambda f: floor.floor_layout(floor.floor_of_feed(f)).withColumn(
        "machine_types", F.concat_ws(",", "machine_types"))),
    "all_machines": _feed(lambda f: floor.all_machines(floor.floor_of_feed(f))),
    "next_on_line": _feed(lambda f: floor.next_on_line(floor.floor_of_feed(f))),
    "machine_type": _feed(_machine_types),
    "machine_location": _feed(lambda f: floor.machine_locations(f.select("machine_name", "datetime"), floor.floor_of_feed(f))),
    "line_of": _feed(lambda f: _per_machine(
        f, production_line=line_of(F.col("machine_name")), strict_line=line_of(F.col("machine_name"), strict=True))),
    "machine_short_name": _feed(lambda f: _per_machine(f, short_name=short_name(F.col("machine_name")))),
    "normalised_status": _normalised,
    "live_floor": _feed(_live),
    "work_order_candidates": _feed(lambda f: floor_views.work_order_candidates(_live(f))),
    "work_order_candidates_without_order": _both(lambda f, w: floor_views.work_order_candidates(_live(f), w)),
}

API: dict[str, Query] = {
    "latest_status": _feed(floor_views.latest_status),
    "latest_status_json": _feed(floor_views.latest_status_json),
    "active_employees": lambda spark, sf: people.active_employees(views.employees(spark, sf)),
    "work_order_list": _orders(orders.work_order_list),
    "work_order_status_counts": _orders(orders.work_order_status_counts),
    "work_order_filter": _orders(lambda w: orders.work_order_filter(
        orders.work_order_list(w), status="in-progress", priority="high", machine="Robotic", assignee="Unassigned")),
    "assignee_options": _orders(orders.assignee_options),
    "work_order_display": _orders(orders.work_order_display),
}

# The streams see the events in two arrivals, before and from this time on.
_SECOND_ARRIVAL = datetime(2024, 1, 16)
# What came before is known as a table where a stream has an initial state.
_STREAM_BEGIN = datetime(2024, 1, 6)

# -- ingest ---------------------------------------------------------------------------------------


def _defaults(spark: SparkSession, sf: str) -> DataFrame:
    given = views.employees(spark, sf).withColumn("active", F.when(F.col("department").isNotNull(), F.col("active")))
    return ingest.with_defaults(given, AS_OF, active=True)


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    return (
        constraints.check_constraints(views.machine_feed(spark, sf), constraints.FEED_RULES)
        .unionByName(constraints.check_constraints(views.order_candidates(spark, sf), constraints.WORK_ORDER_RULES))
        .unionByName(constraints.check_constraints(views.employees(spark, sf), constraints.EMPLOYEE_RULES))
    )


def _violations_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches a table, each checked against the keys of the one before it."""
    root = scratch_dir(spark, "constraints")
    given = [
        (constraints.FEED_RULES, views.machine_feed(spark, sf), F.col("datetime") >= at(_SECOND_ARRIVAL)),
        (constraints.WORK_ORDER_RULES, views.order_candidates(spark, sf), F.hash("created_at") % 2 == 0),
        (constraints.EMPLOYEE_RULES, views.employees(spark, sf), F.col("id") % 2 == 0),
    ]
    for rules, rows, second in given:
        for batch_id, part in enumerate((rows.filter(~second), rows.filter(second))):
            constraints.check_batch(part, rules, root, batch_id)
    return reduce(DataFrame.unionByName, [constraints.violations_so_far(spark, rules, root) for rules, _, _ in given])


def _violating_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = constraints.violating_rows(views.order_candidates(spark, sf), constraints.WORK_ORDER_RULES)
    return rows.select("id", "created_at", F.concat_ws(", ", "broken_rules").alias("broken_rules"))


INGEST: dict[str, Query] = {
    "ingest_accepted": lambda spark, sf: ingest.ingest_work_orders(views.requests(spark, sf), AS_OF)[0],
    "ingest_rejected": lambda spark, sf: ingest.ingest_work_orders(views.requests(spark, sf), AS_OF)[1],
    "ingest_defaults": _defaults,
    "constraint_violations": _violations,
    "constraint_violations_by_batch": _violations_by_batch,
    "constraint_violating_rows": _violating_rows,
}

# -- changes and streams --------------------------------------------------------------------------



def _arrivals(rows: DataFrame, column: str) -> list[DataFrame]:
    """Rows without a time come with the first arrival."""
    later = F.coalesce(F.col(column) >= at(_SECOND_ARRIVAL), F.lit(False))
    return [rows.filter(~later), rows.filter(later)]


def _envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.envelope_json(changes.change_envelopes(views.changes(spark, sf)))


def _change_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return _envelopes(spark, sf).select("seq", "machine_name", "operation", "value")


def _snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    feed = views.machine_feed(spark, sf)
    old = latest_readings(feed.filter(F.col("datetime") < at(day_start(AS_OF, 1))))
    new = latest_readings(feed.filter(F.col("datetime") >= at(day_start(AS_OF, 7))))
    return changes.diff_snapshots(old, new, AS_OF).select(
        "machine_name", "operation",
        F.col("old_data.status").alias("old_status"), F.col("new_data.status").alias("new_status"),
        F.to_timestamp_ntz(F.col("old_data.datetime")).alias("old_datetime"),
        F.to_timestamp_ntz(F.col("new_data.datetime")).alias("new_datetime"),
    )


def _status_update(feed: DataFrame, wo: DataFrame) -> DataFrame:
    snapshot = latest_readings(feed)
    updates = wo.filter((F.col("priority") == "critical") & (F.col("status") == "open")).select(
        F.col("machine_id").alias("machine_name"), F.lit("down").alias("status"), F.col("created_at").alias("datetime"))
    return changes.fold_latest(snapshot, changes.set_status(snapshot, updates))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """The envelopes of all changes; copies of the warning ones, cut off and without a time; of the down ones with a text for a time."""
    whole = _envelopes(spark, sf).select("value", F.col("new_data.status").alias("status"),
                                         F.to_timestamp_ntz(F.col("new_data.datetime")).alias("sent_at"))
    warning, down = whole.filter("status = 'warning'"), whole.filter("status = 'down'")
    timed = lambda text: F.regexp_replace("value", views.TIME_FIELD, f'"datetime":{text}')
    return whole.unionByName(warning.withColumn("value", F.substring("value", 1, 40))) \
        .unionByName(warning.withColumns({"value": timed("null"), "sent_at": F.lit(None).cast("timestamp_ntz")})) \
        .unionByName(down.withColumn("value", timed('"garbage"'))).select("sent_at", "value")


def _sent(spark: SparkSession, arrivals: list[DataFrame], purpose: str, start: Callable) -> str:
    """Stream the messages through a job, an arrival at a time; returns its root folder."""
    root, inbox = scratch_dir(spark, purpose), scratch_dir(spark, "inbox")
    for arrival in arrivals:
        arrival.select("value").write.mode("append").text(inbox)
        start(read_change_stream(spark, inbox), root).awaitTermination()
    return root


def _follow(spark: SparkSession, sf: str) -> str:
    """All messages through the fan-out job, in two arrivals."""
    return _sent(spark, _arrivals(_messages(spark, sf), "sent_at"), "follow", partial(jobs.follow_changes, once=True))


def _followed(read: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, sf: read(spark, _follow(spark, sf))


def _stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = _arrivals(_messages(spark, sf), "sent_at")
    return jobs.current_snapshot(spark, _sent(spark, arrivals, "state", partial(jobs.follow_state, once=True)))


def _stream_live_floor(spark: SparkSession, sf: str) -> DataFrame:
    """A table of what was known at the start, then two arrivals of the stream."""
    feed, begin = views.machine_feed(spark, sf), at(_STREAM_BEGIN)
    arrivals = _arrivals(_messages(spark, sf).filter(F.col("sent_at").isNull() | (F.col("sent_at") >= begin)), "sent_at")
    job = partial(jobs.follow_state, once=True, initial=feed.filter(F.col("datetime") < begin))
    return jobs.current_floor(spark, _sent(spark, arrivals, "state", job), floor.floor_of_feed(feed))


# A reading of no machine of the floor, long after all others: it closes what waits for the watermark.
_LAST_READING = '{"operation":"INSERT","table":"t","timestamp":0,"new_data":{"machine_name":"Clock","datetime":"2024-03-01T00:00:00"}}'


def _dated_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _envelopes(spark, sf).select("seq", "value", F.to_timestamp_ntz(F.col("new_data.datetime")).alias("sent_at"))


def _ending(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(_LAST_READING).alias("value"))


def _stream_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Readings arrive out of order within each arrival; the transitions come out as the batch report has them."""
    arrivals = [*_arrivals(_dated_messages(spark, sf), "sent_at"), _ending(spark)]
    root = _sent(spark, arrivals, "transitions", partial(jobs.follow_transitions, delay="1 hour", once=True))
    rows = tables.read_table(spark, f"{root}/transitions", schemas.TRANSITIONS)
    return machine.changes_from_transitions(rows, AS_OF)


def _stream_hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every five-hundredth reading of the first arrival comes once more, too late to be counted."""
    sent = _dated_messages(spark, sf)
    first, second = _arrivals(sent, "sent_at")
    late = first.filter("seq % 500 = 0")
    root = _sent(spark, [first, second, late.select("value").unionByName(_ending(spark))], "hours",
                 partial(jobs.follow_hours, delay="1 hour", once=True))
    history = changes.readings_of(changes.parse_envelopes(sent.select("value").unionByName(late.select("value"))))
    return stateful.late_readings(history, tables.read_table(spark, f"{root}/hours", schemas.HOURS))


def _stream_change_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    root, inbox = scratch_dir(spark, "publish"), scratch_dir(spark, "inbox")
    rows = views.changes(spark, sf)
    for arrival in _arrivals(rows, "changed_at"):
        arrival.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        jobs.publish_changes(stream, root, once=True).awaitTermination()
    return tables.read_table(spark, f"{root}/envelopes", schemas.PUBLISHED)


def _work_order_append(spark: SparkSession, sf: str) -> DataFrame:
    root, inbox = scratch_dir(spark, "orders"), scratch_dir(spark, "inbox")
    rows = views.requests(spark, sf)
    second = F.col("request_key") % 2 == 0
    for arrival in (rows.filter(~second), rows.filter(second | (F.col("request_key") % 7 == 0))):  # some of the first come again
        arrival.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        jobs.follow_requests(stream, root, as_of=AS_OF, once=True).awaitTermination()
    return tables.read_stored_work_orders(spark, f"{root}/work_orders").drop("created_date", "batch_id")


def _late_parts(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two arrivals; a tenth of the first, undated readings apart, comes with the second."""
    late = F.hash("datetime") % 10 == 0
    first, second = _arrivals(feed, "datetime")
    return first.filter(~late), second.unionByName(first.filter(late))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries by day and batch, the second batch with readings that come late for days of the first."""
    path = scratch_dir(spark, "variants")
    for batch_id, part in enumerate(_late_parts(views.machine_feed(spark, sf))):
        tables.append_variants(part, path, batch_id)
    return tables.read_variants(spark, path)


def _clustered(plan: Callable[[DataFrame], DataFrame]) -> Query:
    """A report on neighbouring readings from the history clustered in two runs."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_dir(spark, "clustered")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        for part in _arrivals(views.machine_feed(spark, sf), "datetime"):
            clustered.add_days(part, table, path, buckets=16)
        return plan(machine.clustered_transitions(spark, table, AS_OF))
    return run


LAYOUTS: dict[str, Query] = {
    "latest_status_from_summaries": lambda spark, sf: floor_views.latest_status_from_variants(_variants(spark, sf)),
    "current_machine_status_from_summaries": lambda spark, sf: machine.current_status_from_variants(_variants(spark, sf), AS_OF),
    "machine_uptime_7days_clustered": _clustered(lambda readings: machine.uptime_from_transitions(readings, AS_OF)),
    "problematic_machines_30days_clustered": _clustered(lambda readings: machine.problems_from_transitions(readings, AS_OF)),
    "machine_status_changes_7days_clustered": _clustered(lambda readings: machine.changes_from_transitions(readings, AS_OF)),
}

STREAMS: dict[str, Query] = {
    "change_envelopes": _change_envelopes,
    "snapshot_diff": _snapshot_diff,
    "status_update": _both(_status_update),
    "stream_change_envelopes": _stream_change_envelopes,
    "stream_latest": _stream_latest,
    "stream_status_changes_7days": _stream_status_changes,
    "stream_hourly_counts": _stream_hourly_counts,
    "stream_history": _followed(lambda spark, root: tables.read_history(spark, f"{root}/history").drop("batch_id")),
    "stream_live_floor": _stream_live_floor,
    "stream_message_log": _followed(lambda spark, root: tables.read_table(spark, f"{root}/messages", schemas.MESSAGE)),
    "stream_dead_letters": _followed(lambda spark, root: tables.read_dead_letters(spark, f"{root}/messages")),
    "stream_down_alerts": _followed(lambda spark, root: tables.read_feed(spark, f"{root}/down_alerts")),
    "work_order_append": _work_order_append,
}

QUERIES: dict[str, Query] = {
    **{name: _gold(name) for name in gold.GOLD_TABLES},
    **SOURCES, **REPORTS, **TILES, **FLOOR, **API, **INGEST, **LAYOUTS, **STREAMS,
    **{f"gold_roundtrip_{name}": _gold_roundtrip(name) for name in gold.GOLD_TABLES},
    "gold_refresh": _gold_refresh,
    "gold_refresh_incremental": _gold_refresh_incremental,
}

ORACLE: dict[str, str] = {
    **oracle.GOLD, **oracle.SOURCES, **oracle.REPORTS, **oracle.TILES, **oracle.FLOOR, **oracle.API, **oracle.INGEST, **oracle.LAYOUTS, **oracle.STREAMS,
    **{f"gold_roundtrip_{name}": sql for name, sql in oracle.GOLD.items()},
    "gold_refresh": oracle.GOLD_ROWS,
    "gold_refresh_incremental": oracle.GOLD_ROWS,
}
