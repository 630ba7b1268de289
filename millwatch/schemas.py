"""Explicit schemas of every input; nothing is inferred."""

from pyspark.sql import types as T

FEED = T.StructType([
    T.StructField("machine_id", T.IntegerType()),
    T.StructField("machine_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("datetime", T.TimestampNTZType()),
])

# The history table is the feed plus its two partition columns.
HISTORY = T.StructType(FEED.fields + [
    T.StructField("event_date", T.DateType()),
    T.StructField("batch_id", T.LongType()),
])

WORK_ORDERS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("machine_id", T.StringType()),
    T.StructField("issue_description", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("reporter_name", T.StringType()),
    T.StructField("assignee", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
])

# Stored work orders carry two partition columns as well.
STORED_WORK_ORDERS = T.StructType(WORK_ORDERS.fields + [
    T.StructField("created_date", T.DateType()),
    T.StructField("batch_id", T.LongType()),
])

EMPLOYEES = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

REQUEST = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("issue_description", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("reporter_name", T.StringType()),
    T.StructField("assignee", T.StringType()),
])

# One machine row inside a change envelope: the time travels as ISO text.
IMAGE = T.StructType([
    T.StructField("machine_id", T.IntegerType()),
    T.StructField("machine_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("datetime", T.StringType()),
])

ENVELOPE = T.StructType([
    T.StructField("operation", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("new_data", IMAGE),
    T.StructField("old_data", IMAGE),
])

MESSAGE = T.StructType([T.StructField("value", T.StringType())])

# The streamed state: the newest reading of each variant of a machine.
VARIANTS = T.StructType([
    T.StructField("machine_name", T.StringType()),
    T.StructField("machine_id", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("newest", T.TimestampNTZType()),
    T.StructField("undated", T.BooleanType()),
])

# The same by day and batch, as it is written with the history.
DAY_VARIANTS = T.StructType(VARIANTS.fields + [
    T.StructField("event_date", T.DateType()),
    T.StructField("batch_id", T.LongType()),
])


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}


def _gold(columns: str) -> T.StructType:
    pairs = [c.split() for c in f"{columns}, last_updated timestamp_ntz".split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


GOLD = {
    "current_machine_status": _gold("production_line string, equipment_type string, status string, machine_count bigint, percentage double"),
    "machine_uptime_7days": _gold("production_line string, machine_name string, type string, uptime_percentage double, "
                                  "operational_hours double, downtime_hours double"),
    "problematic_machines_30days": _gold("production_line string, machine_name string, type string, downtime_incidents bigint, "
                                         "days_with_issues bigint, first_incident timestamp_ntz, last_incident timestamp_ntz"),
    "hourly_status_patterns": _gold("hour_of_day int, operational_count bigint, down_count bigint, warning_count bigint, "
                                    "total_readings bigint, downtime_percentage double, uptime_percentage double, "
                                    "warning_percentage double"),
    "work_order_status_summary": _gold("status string, order_count bigint, percentage double, avg_resolution_hours double, "
                                       "critical_count bigint, unassigned_count bigint"),
    "work_order_trends_30days": _gold("order_date date, daily_count bigint, seven_day_moving_avg double, volume_indicator string"),
    "machine_status_changes_7days": _gold("status_date date, status_hour int, machine_name string, production_line string, "
                                          "type string, status string, previous_status string, status_change_type string"),
    "executive_kpis": _gold("metric_category string, metric_name string, current_value double, target_value double, value_type string"),
}
PUBLISHED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", T.StringType())])

# A reading with the status before it, as the stream puts it out.
TRANSITIONS = T.StructType(FEED.fields + [
    T.StructField("prev_status", T.StringType()),
    T.StructField("prev_datetime", T.TimestampNTZType()),
])

HOURS = T.StructType([T.StructField("hour", T.TimestampNTZType()), *[
    T.StructField(c, T.LongType()) for c in ("operational_count", "down_count", "warning_count", "total_readings")]])

# What the incremental refresh keeps of a day.
_EDGE = "struct<datetime: timestamp_ntz, type: string, status: string, there: boolean>"
DAY_PARTS = {
    "hours": "hour_of_day int, operational_count bigint, down_count bigint, warning_count bigint, total_readings bigint, event_date date",
    "machines": "machine_name string, type string, running decimal(38,0), total decimal(38,0), incidents bigint, "
                "first_incident timestamp_ntz, last_incident timestamp_ntz, event_date date",
    "edges": f"machine_name string, first_reading {_EDGE}, last_reading {_EDGE}, event_date date",
    "changes": "machine_name string, type string, datetime timestamp_ntz, status string, prev_datetime timestamp_ntz, "
               "prev_status string, event_date date",
}
