"""Gold tables from parts by day: a refresh reads the days that changed, not the whole look-back.

Four parts are kept by day: counts by hour; by machine and type the time and the incidents
between readings of the same day; the first and last reading of each machine; and the
readings with the status before them on that day.  What lies between the days of a machine
follows from its first and last readings, one row a machine and day, whatever the number of
readings.  A reading that comes late changes its own day only, so the days of all batches
since the last refresh are worked out again, and no other.

Parts replace whole days.  A changed day always has rows in each part that had some
before, so nothing outdated stays.  The batch that parts cover is noted after they are
written; a run that fails in between repeats the same days.  One writer at a time.
Work orders change in place and are read in full.
"""

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwatch import schemas
from millwatch.functions.times import at, day_start, micros_between, sum_micros
from millwatch.operators.neighbours import with_neighbours
from millwatch.plans import gold, machine
from millwatch.session import exists, scratch_dropped, stored


def changed_rows(history: DataFrame, days: list[date]) -> DataFrame:
    """The readings of some days; the days prune the partitions of the history."""
    return history.filter(F.col("event_date").isin(days)).select("machine_name", "type", *machine.READING_ORDER)


def _day_transitions(history: DataFrame, days: list[date]) -> DataFrame:
    """Readings of some days with their neighbours on the same day."""
    found = with_neighbours(changed_rows(history, days), "machine_name", machine.READING_ORDER, before=["datetime", "status"], after=["datetime"])
    day = F.to_date("datetime")
    inside = lambda c, side: F.when(F.to_date(f"{side}_datetime") == day, F.col(c)).alias(c)
    return found.select(day.alias("event_date"), "machine_name", "type", "datetime", "status",
                        inside("prev_datetime", "prev"), inside("prev_status", "prev"), inside("next_datetime", "next"))


def _parts_of(readings: DataFrame) -> dict[str, DataFrame]:
    """The parts of the days that ``readings`` holds."""
    lasted = micros_between(F.col("datetime"), F.col("next_datetime"))
    fell = (F.col("status") == "down") & (F.col("prev_status") == "operational")
    side = lambda c: F.struct("datetime", "type", "status", F.lit(True).alias("there")).alias(c)
    first = readings.filter("prev_datetime is null").select("event_date", "machine_name", side("first_reading"), F.lit(None).alias("last_reading"))
    last = readings.filter("next_datetime is null").select("event_date", "machine_name", F.lit(None).alias("first_reading"), side("last_reading"))
    return {
        "hours": machine.counts_by_hour(readings, "event_date"),
        "machines": readings.withColumns({"lasted": lasted, "fell_at": F.when(fell, F.col("datetime"))})
        .groupBy("event_date", "machine_name", "type")
        .agg(sum_micros("if(status = 'operational', lasted, 0)").alias("running"), sum_micros("lasted").alias("total"),
             F.count("fell_at").alias("incidents"), F.min("fell_at").alias("first_incident"), F.max("fell_at").alias("last_incident")),
        "edges": first.unionByName(last).groupBy("event_date", "machine_name").agg(
            F.first("first_reading", ignorenulls=True).alias("first_reading"), F.first("last_reading", ignorenulls=True).alias("last_reading")),
        "changes": readings.filter("prev_datetime is not null").select(
            "event_date", "machine_name", "type", "datetime", "status", "prev_datetime", "prev_status"),
    }


def _read(spark: SparkSession, parts: str, name: str, as_of: datetime, days: int) -> DataFrame:
    rows = spark.read.schema(schemas.DAY_PARTS[name]).parquet(f"{parts}/{name}")
    return rows.filter(F.col("event_date") >= F.lit(day_start(as_of, days).date()))


def covered_batch(spark: SparkSession, parts: str) -> int | None:
    """The newest batch whose readings are in the parts."""
    if not exists(spark, f"{parts}/_covered"):
        return None
    return spark.read.schema("batch bigint").parquet(f"{parts}/_covered").agg(F.max("batch")).first()[0]


def update_parts(spark: SparkSession, history: DataFrame, parts: str) -> list[date]:
    """Bring the parts up to the history (with ``event_date`` and ``batch_id``); returns the days worked out again.

    The driver holds one row a changed day.
    """
    seen = covered_batch(spark, parts)
    new = history if seen is None else history.filter(F.col("batch_id") > seen)
    found = new.groupBy("event_date").agg(F.max("batch_id").alias("batch")).collect()
    days = sorted(r["event_date"] for r in found if r["event_date"] is not None)
    if days or (seen is None and not exists(spark, f"{parts}/edges")):
        with scratch_dropped(spark):
            for name, rows in _parts_of(stored(_day_transitions(history, days), "day-transitions")).items():
                rows.hint("rebalance", "event_date").write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{parts}/{name}")
    if found:
        row = spark.range(1).select(F.lit(max(r["batch"] for r in found)).cast("bigint").alias("batch"))
        row.coalesce(1).write.mode("append").parquet(f"{parts}/_covered")
    return days


def edges_between_days(spark: SparkSession, parts: str, as_of: datetime, days: int) -> DataFrame:
    """First and last reading of each machine and day, with the last one before and the first one after that day."""
    along = Window.partitionBy("machine_name").orderBy("event_date")
    return _read(spark, parts, "edges", as_of, days).select(
        "*", F.lag("last_reading").over(along).alias("before"), F.lead("first_reading").over(along).alias("after"))


def uptime_from_parts(spark: SparkSession, parts: str, as_of: datetime, days: int = 7) -> DataFrame:
    lasted = micros_between(F.col("last_reading.datetime"), F.coalesce(F.col("after.datetime"), at(as_of)))
    over_night = edges_between_days(spark, parts, as_of, days).select(
        "machine_name", F.col("last_reading.type").alias("type"), lasted.cast("decimal(38,0)").alias("total"),
        F.when(F.col("last_reading.status") == "operational", lasted).otherwise(0).cast("decimal(38,0)").alias("running"))
    within = _read(spark, parts, "machines", as_of, days).select("machine_name", "type", "total", "running")
    sums = within.unionByName(over_night).groupBy("machine_name", "type").agg(
        F.sum("running").cast("decimal(38,0)").alias("running"), F.sum("total").cast("decimal(38,0)").alias("total"))
    return machine.uptime_of_sums(sums, as_of)


def problems_from_parts(spark: SparkSession, parts: str, as_of: datetime, days: int = 30) -> DataFrame:
    fell = (F.col("first_reading.status") == "down") & (F.col("before.status") == "operational")
    over_night = edges_between_days(spark, parts, as_of, days).filter(fell).select(
        "event_date", "machine_name", F.col("first_reading.type").alias("type"), F.lit(1).cast("bigint").alias("incidents"),
        F.col("first_reading.datetime").alias("first_incident"), F.col("first_reading.datetime").alias("last_incident"))
    within = _read(spark, parts, "machines", as_of, days).filter("incidents > 0").select(*over_night.columns)
    return within.unionByName(over_night).groupBy("machine_name", "type").agg(
        F.sum("incidents").alias("downtime_incidents"), F.countDistinct("event_date").alias("days_with_issues"),
        F.min("first_incident").alias("first_incident"), F.max("last_incident").alias("last_incident"),
    ).select(*machine.problem_columns(as_of))


def changes_from_parts(spark: SparkSession, parts: str, as_of: datetime, days: int = 7) -> DataFrame:
    over_night = edges_between_days(spark, parts, as_of, days).filter("before.there").select(
        "event_date", "machine_name", "first_reading.type", "first_reading.datetime", "first_reading.status",
        F.col("before.datetime").alias("prev_datetime"), F.col("before.status").alias("prev_status"))
    within = _read(spark, parts, "changes", as_of, days).select(*over_night.columns)
    return machine.changes_from_transitions(within.unionByName(over_night), as_of, days)


def hours_from_parts(spark: SparkSession, parts: str, as_of: datetime, days: int = 30) -> DataFrame:
    counts = _read(spark, parts, "hours", as_of, days).groupBy("hour_of_day").agg(
        *[F.sum(c).alias(c) for c in machine.HOUR_COUNTS])
    return machine.patterns_of_counts(counts, as_of)


def refresh_gold_incremental(spark: SparkSession, history: DataFrame, work_orders: DataFrame, as_of: datetime, root: str,
                             parts: str, variants: DataFrame) -> str:
    """What ``refresh_gold`` writes, as a new version, from parts by day and the summaries of variants; returns the version.

    Of the history it reads the changed days, and for the KPIs the last day.
    """
    update_parts(spark, history, parts)
    version = uuid.uuid4().hex
    with scratch_dropped(spark):
        gold.write_version(spark, {"feed": history, "work_orders": work_orders}, {
            "current_machine_status": machine.current_status_from_variants(variants, as_of),
            "machine_uptime_7days": uptime_from_parts(spark, parts, as_of),
            "problematic_machines_30days": problems_from_parts(spark, parts, as_of),
            "hourly_status_patterns": hours_from_parts(spark, parts, as_of),
            "machine_status_changes_7days": changes_from_parts(spark, parts, as_of),
        }, as_of, root, version)
    return version
