"""The newest reading per machine.

The first aggregate groups by everything but the time, which leaves numbers in
its buffers: a hash aggregate with map-side combine that reduces any history to
a few rows per machine, its variants, before the first shuffle, however hot the machine is.
Variants fold: those of a history are those of its parts taken together.

Reports count a missing time as newest.  A stream does not: there a reading without
a time would hold its machine for good, so any dated one comes before it.  Equal times
fall back to the larger machine id, status and type.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_VARIANT = ["machine_name", "machine_id", "status", "type"]


def newest_variants(feed: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per (machine, id, status, type): the newest time, and whether a reading came without one.  Works on a stream as well.

    ``by`` names further columns to tell variants apart.
    """
    rows = feed.select(*_VARIANT, F.col("datetime").alias("newest"), F.col("datetime").isNull().alias("undated"), *by)
    return folded_variants(rows, by)


def folded_variants(variants: DataFrame, by: list[str] = ()) -> DataFrame:
    """What ``newest_variants`` of all readings behind these variants would give."""
    return variants.groupBy(*_VARIANT, *by).agg(F.max("newest").alias("newest"), F.max("undated").alias("undated"))


def _readings(variants: DataFrame, undated_first: bool) -> DataFrame:
    undated = F.col("undated") if undated_first else F.col("newest").isNull()
    first = undated if undated_first else ~undated
    return variants.select(
        "machine_name", "type",
        F.struct(first.alias("first"), F.when(~undated, F.col("newest")).alias("datetime"),
                 "machine_id", "status", "type").alias("reading"))


def latest_of_variants(variants: DataFrame, undated_first: bool = True) -> DataFrame:
    """One row per machine: ``machine_id, machine_name, status, type, datetime``."""
    return (
        _readings(variants, undated_first)
        .groupBy("machine_name").agg(F.max("reading").alias("r"))
        .select("r.machine_id", "machine_name", "r.status", "r.type", "r.datetime")
    )


def latest_readings(feed: DataFrame) -> DataFrame:
    return latest_of_variants(newest_variants(feed))


def latest_status_by_type(variants: DataFrame) -> DataFrame:
    """Each (machine, type) seen, with the newest status of the machine over all its types."""
    machine = Window.partitionBy("machine_name")
    return (
        _readings(variants, undated_first=True)
        .select("machine_name", "type", F.max("reading").over(machine)["status"].alias("status"))
        .distinct()
    )
