"""Machine performance and downtime reports over the status history."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.functions.machines import line_of
from millwatch.functions.ratios import percent, ratio
from millwatch.functions.times import MICROS_PER_HOUR, at, day_start, micros_between, since, sum_micros
from millwatch.operators.latest import latest_status_by_type, newest_variants
from millwatch.operators.neighbours import neighbours_in_ranges, with_neighbours
from millwatch.sources import clustered

READING_ORDER = ["datetime", "machine_id", "status"]


def _line():
    return line_of(F.col("machine_name")).alias("production_line")


def _count_status(status: str):
    return F.count_if(F.col("status") == status)


def current_machine_status(feed: DataFrame, as_of: datetime) -> DataFrame:
    """Machines by line, type and newest status, with their share of all."""
    return current_status_from_variants(newest_variants(feed), as_of)


def current_status_from_variants(variants: DataFrame, as_of: datetime) -> DataFrame:
    """The same from the streamed variants, without a scan of the history."""
    counted = (
        latest_status_by_type(variants)
        .groupBy(_line(), F.col("type").alias("equipment_type"), "status")
        .agg(F.count(F.lit(1)).alias("machine_count"))
    )
    return counted.select(
        "production_line", "equipment_type", "status", "machine_count",
        percent("machine_count", "sum(machine_count) over ()").alias("percentage"),
        at(as_of).alias("last_updated"),
    )


def transitions(feed: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Readings of the look-back with the time and status around each.

    One pass serves the uptime, incident and status-change reports: a shorter
    look-back only forgets neighbours that fall outside it.
    """
    return with_neighbours(
        since(feed, "datetime", as_of, days).select("machine_name", "type", *READING_ORDER),
        "machine_name", READING_ORDER, before=["datetime", "status"], after=["datetime"],
    )


def clustered_transitions(spark: SparkSession, table: str, as_of: datetime, days: int = 30) -> DataFrame:
    """The same from the clustered history: the window works in the table's buckets, no row is shuffled below it."""
    placed = clustered.read_placed(spark, table, as_of, days)
    columns = ["machine_name", "type", *READING_ORDER]
    return neighbours_in_ranges(placed, columns, "machine_name", clustered.ALONG, ["datetime", "status"], ["datetime"])


def machine_uptime(feed: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Uptime by machine: each reading lasts until the next one, the last until ``as_of``.

    Warning time counts as downtime.
    """
    readings = with_neighbours(
        since(feed, "datetime", as_of, days).select("machine_name", "type", *READING_ORDER),
        "machine_name", READING_ORDER, after=["datetime"],
    )
    return uptime_from_transitions(readings, as_of, days)


def uptime_from_transitions(readings: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    lasted = micros_between(F.col("datetime"), F.coalesce(F.col("next_datetime"), at(as_of)))
    return uptime_of_sums(
        since(readings, "datetime", as_of, days)
        .select("machine_name", "type", "status", lasted.alias("lasted"))
        .groupBy("machine_name", "type")
        .agg(sum_micros("if(status = 'operational', lasted, 0)").alias("running"), sum_micros("lasted").alias("total")),
        as_of)


def uptime_of_sums(sums: DataFrame, as_of: datetime) -> DataFrame:
    """The report from the microseconds ``running`` and ``total`` by machine and type."""
    return sums.select(
        _line(), "machine_name", "type",
        percent("running", "total").alias("uptime_percentage"),
        ratio("running", MICROS_PER_HOUR).alias("operational_hours"),
        ratio("(total - running)", MICROS_PER_HOUR).alias("downtime_hours"),
        at(as_of).alias("last_updated"),
    )


def problematic_machines(feed: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Machines that went from operational straight to down: how often, on how many days, first and last."""
    readings = with_neighbours(
        since(feed, "datetime", as_of, days).select("machine_name", "type", *READING_ORDER),
        "machine_name", READING_ORDER, before=["status"],
    )
    return problems_from_transitions(readings, as_of)


def problems_from_transitions(readings: DataFrame, as_of: datetime) -> DataFrame:
    return (
        readings
        .filter((F.col("status") == "down") & (F.col("prev_status") == "operational"))
        .groupBy("machine_name", "type")
        .agg(
            F.count(F.lit(1)).alias("downtime_incidents"),
            F.countDistinct(F.to_date("datetime")).alias("days_with_issues"),
            F.min("datetime").alias("first_incident"),
            F.max("datetime").alias("last_incident"),
        )
        .select(*problem_columns(as_of))
    )


def problem_columns(as_of: datetime) -> list:
    return [_line(), "machine_name", "type", "downtime_incidents", "days_with_issues", "first_incident", "last_incident",
            at(as_of).alias("last_updated")]


def hourly_status_patterns(feed: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Readings by hour of the day, with the share of each status."""
    return patterns_of_counts(counts_by_hour(since(feed, "datetime", as_of, days)), as_of)


HOUR_COUNTS = ["operational_count", "down_count", "warning_count", "total_readings"]


def counts_by_hour(readings: DataFrame, *by: str) -> DataFrame:
    return readings.groupBy(*by, F.hour("datetime").alias("hour_of_day")).agg(
        _count_status("operational").alias("operational_count"),
        _count_status("down").alias("down_count"),
        _count_status("warning").alias("warning_count"),
        F.count(F.lit(1)).alias("total_readings"),
    )


def patterns_of_counts(counts: DataFrame, as_of: datetime) -> DataFrame:
    """The report from the counts by hour of the day."""
    return counts.select(
        "hour_of_day", *HOUR_COUNTS,
        percent("down_count", "total_readings").alias("downtime_percentage"),
        percent("operational_count", "total_readings").alias("uptime_percentage"),
        percent("warning_count", "total_readings").alias("warning_percentage"),
        at(as_of).alias("last_updated"),
    )


def line_efficiency(feed: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Operational share of the readings by line, best first.

    Counting per machine first keeps the name matching off the raw rows and
    turns the distinct machine count into a plain one.
    """
    per_machine = (
        since(feed, "datetime", as_of, days)
        .groupBy("machine_name")
        .agg(_count_status("operational").alias("up"), _count_status("down").alias("down"),
             F.count(F.lit(1)).alias("readings"))
    )
    return (
        per_machine.groupBy(_line())
        .agg(
            F.count("machine_name").alias("total_machines"),
            F.sum("up").alias("operational_readings"),
            F.sum("down").alias("down_readings"),
            F.sum("readings").alias("total_readings"),
        )
        .select(
            "production_line", "total_machines",
            percent("operational_readings", "total_readings").alias("efficiency_percentage"),
            "operational_readings", "down_readings", "total_readings",
        )
        .orderBy(F.col("efficiency_percentage").desc_nulls_first(), "production_line")
    )


def machine_status_changes(feed: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Every reading with one before it, marked FAILURE, RECOVERY or STABLE."""
    readings = with_neighbours(
        since(feed, "datetime", as_of, days).select("machine_name", "type", *READING_ORDER),
        "machine_name", READING_ORDER, before=["datetime", "status"],
    )
    return changes_from_transitions(readings, as_of, days)


def changes_from_transitions(readings: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    known = F.col("prev_datetime") >= at(day_start(as_of, days))
    previous = F.when(known, F.col("prev_status")).alias("previous_status")
    fell = (F.col("status") == "down") & (F.col("previous_status") == "operational")
    rose = (F.col("status") == "operational") & (F.col("previous_status") == "down")
    return (
        since(readings, "datetime", as_of, days)
        .select("datetime", "machine_name", "type", "status", previous)
        .filter(F.col("previous_status").isNotNull())
        .select(
            F.to_date("datetime").alias("status_date"), F.hour("datetime").alias("status_hour"),
            "machine_name", _line(), "type", "status", "previous_status",
            F.when(fell, "FAILURE").when(rose, "RECOVERY").otherwise("STABLE").alias("status_change_type"),
            at(as_of).alias("last_updated"),
        )
    )
