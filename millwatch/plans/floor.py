"""Live floor view and the row results of the machine API."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch.functions.machines import display_status, machine_icon, machine_type, short_name
from millwatch.functions.times import iso_text
from millwatch.operators.latest import latest_of_variants, latest_readings, newest_variants


def latest_status(feed: DataFrame) -> DataFrame:
    """Newest reading of each machine: name, status, type, time."""
    return latest_status_from_variants(newest_variants(feed))


def latest_status_from_variants(variants: DataFrame) -> DataFrame:
    """The same from summaries of the history or from the streamed state."""
    return latest_of_variants(variants).select("machine_name", "status", "type", "datetime")


def latest_status_json(feed: DataFrame) -> DataFrame:
    """One key and one JSON document per machine, ready for a key/value sink."""
    document = F.struct("status", "type", iso_text(F.col("datetime")).alias("datetime"))
    return latest_readings(feed).select(
        F.col("machine_name").alias("key"), F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def live_floor(floor: DataFrame, latest: DataFrame) -> DataFrame:
    """Every machine of the floor with its display status; ``unknown`` until it reports.

    Readings of machines that are not on the floor do not show.
    """
    known = latest.select(F.col("machine_name").alias("_name"), F.col("status").alias("_status"), "datetime")
    kind = machine_type(F.col("name"))
    return floor.join(known, floor["name"] == known["_name"], "left").select(
        "line_order", "line", "position", "name", short_name(F.col("name")).alias("short_name"),
        kind.alias("type"), machine_icon(kind).alias("icon"),
        display_status(F.col("_status")).alias("status"), F.col("datetime").alias("reported_at"),
    )


def work_order_candidates(floor_view: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Machines shown as down.  With ``orders``, only those without an unfinished order."""
    down = floor_view.filter(F.col("status") == "down").select("line", "position", "name", "type")
    if orders is None:
        return down
    unfinished = orders.filter(F.col("status").isin(*fv.UNFINISHED)).select(F.col("machine_id").alias("name")).distinct()
    return down.join(unfinished, "name", "left_anti").select("line", "position", "name", "type")
