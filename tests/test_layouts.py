"""The clustered history and the summaries by day: same rows as the plain history, less work."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwatch import schemas
from millwatch.operators.latest import newest_variants
from millwatch.plans import machine
from millwatch.session import scratch_dir
from millwatch.sources import clustered, tables

NOW, START = datetime(2024, 1, 31), datetime(2024, 1, 25)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def feed(spark):
    """A machine with most of the readings, many of them at one moment or equal, and some others over several days."""
    rows = [(1, "Hot", "down" if i % 3 else "operational", "valve", START + timedelta(minutes=i // 40 * 7)) for i in range(4000)]
    rows += [(2, "Hot", "warning", "valve", START + timedelta(hours=30))] * 500
    rows += [(i, f"M{i % 5}", ["down", "operational", None][i % 3], "valve", START + timedelta(hours=i)) for i in range(120)]
    rows += [(9, None, "down", "valve", START + timedelta(hours=3)), (9, None, "operational", "valve", START + timedelta(hours=50)), (7, "M1", "down", "valve", None)]
    return spark.createDataFrame(rows, schemas.FEED).cache()


@pytest.fixture(scope="module")
def table(spark, feed):
    path = scratch_dir(spark, "clustered")
    day = F.col("datetime") >= F.lit(datetime(2024, 1, 27))
    for part in (feed.filter(~F.coalesce(day, F.lit(False))), feed.filter(day)):
        clustered.add_days(part, "clustered_history", path, buckets=8)
    yield "clustered_history"
    spark.sql("drop table clustered_history")


def test_reports_from_the_clustered_history(spark, feed, table):
    readings = machine.clustered_transitions(spark, table, NOW, 7)
    assert _rows(machine.uptime_from_transitions(readings, NOW)) == _rows(machine.machine_uptime(feed, NOW))
    assert _rows(machine.changes_from_transitions(readings, NOW)) == _rows(machine.machine_status_changes(feed, NOW))
    assert _rows(clustered.read_readings(spark, table).groupBy(*schemas.FEED.fieldNames()).agg(F.sum("copies").alias("count"))) == _rows(
        feed.groupBy(*schemas.FEED.fieldNames()).count())


def test_nothing_is_shuffled_below_the_window(spark, table):
    plan = machine.clustered_transitions(spark, table, NOW, 7)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if "Window " in line]
    assert windows
    for i in windows:
        depth = lines[i].index("Window")
        if "_range" not in lines[i].split("windowspecdefinition(", 1)[1].split(",")[0]:
            continue
        below = []
        for line in lines[i + 1:]:
            if len(line) - len(line.lstrip(" :+-*()0123456789")) <= depth and "Scan" not in line and below and below[-1].count("Scan"):
                break
            below.append(line)
            if "Scan" in line:
                break
        assert not any("Exchange" in line for line in below), "\n".join(below)
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_a_hot_machine_is_in_many_ranges(spark, table):
    ranges = spark.table(table).filter("machine_name = 'Hot'").select("part").distinct().count()
    assert ranges >= 5


def test_days_are_added_once(spark, feed, table):
    with pytest.raises(ValueError):
        clustered.add_days(feed.limit(3), table, buckets=8)


def test_summaries_fold_to_the_variants_of_the_history(spark, feed):
    path = scratch_dir(spark, "variants")
    late = F.hash("datetime", "status") % 4 == 0
    for _ in range(2):  # a replayed batch changes nothing
        tables.append_variants(feed.filter(~late), path, 0)
    tables.append_variants(feed.filter(late), path, 1)
    assert _rows(tables.read_variants(spark, path)) == _rows(newest_variants(feed))
    until = feed.filter(F.col("datetime").isNull() | (F.to_date("datetime") <= F.lit(date(2024, 1, 26))))
    assert _rows(tables.read_variants(spark, path, date(2024, 1, 26))) == _rows(newest_variants(until))
    assert spark.read.parquet(path).count() < feed.count() / 20
