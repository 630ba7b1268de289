"""The floor as a dimension: which machine stands where on which line.

Machines are as many as the floor has; lines are few.  Places along a line come from
ranges and counts from aggregates, so no line is a task.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch.functions.machines import line_of, machine_icon, machine_type
from millwatch.operators.ranges import with_start


def configured_floor(spark: SparkSession, layout: dict[str, list[str]] | None = None) -> DataFrame:
    """``line_order, line, position, name`` from a line -> machines mapping."""
    rows = [(i, line, names) for i, (line, names) in enumerate((layout or fv.FLOOR_LAYOUT).items())]
    lines = spark.createDataFrame(rows, "line_order int, line string, names array<string>")
    return lines.select("line_order", "line", F.posexplode("names").alias("position", "name"))


def floor_of_feed(feed: DataFrame) -> DataFrame:
    """A floor made of the machines that report: grouped by reporting line, ordered by name."""
    names = feed.select(F.col("machine_name").alias("name")).filter(F.col("name").isNotNull()).distinct()
    placed = with_start(names.withColumn("line", line_of(F.col("name"))), "line", ["name"], name="position")
    lines = [line for _, line in fv.LINE_BY_PATTERN] + [fv.UNKNOWN_LINE]
    order = F.array_position(F.array(*map(F.lit, lines)), F.col("line")) - 1
    return placed.select(order.cast("int").alias("line_order"), "line", F.col("position").cast("int").alias("position"), "name")


def _with_line_size(floor: DataFrame, name: str) -> DataFrame:
    """One row per line joins its machines; Spark broadcasts so few rows by their measured size."""
    sizes = floor.groupBy(F.col("line").alias("_line")).agg(F.count(F.lit(1)).alias(name))
    return floor.join(sizes, F.col("line").eqNullSafe(F.col("_line"))).drop("_line")


def floor_layout(floor: DataFrame) -> DataFrame:
    """Every machine in floor order with its type, icon, position and the machine counts."""
    kind = machine_type(F.col("name"))
    return _with_line_size(floor, "machine_count").select(
        "line_order", "line", "position", "name", kind.alias("type"), machine_icon(kind).alias("icon"),
        "machine_count", floor.agg(F.count(F.lit(1))).scalar().alias("total_machines"),
        F.array(*map(F.lit, fv.ICON_BY_TYPE)).alias("machine_types"),
    ).orderBy("line_order", "position")


def all_machines(floor: DataFrame) -> DataFrame:
    """Machine names in floor order."""
    return floor.orderBy("line_order", "position").select("name")


def next_on_line(floor: DataFrame) -> DataFrame:
    """Each machine with the one its product flows to: the next position of the line."""
    after = floor.select(F.col("line").alias("_line"), (F.col("position") - 1).alias("_position"), F.col("name").alias("next_name"))
    at = F.col("line").eqNullSafe(F.col("_line")) & (F.col("position") == F.col("_position"))
    return floor.join(after, at, "left").select("line", "position", "name", "next_name")


def machine_locations(names: DataFrame, floor: DataFrame, column: str = "machine_name") -> DataFrame:
    """``names`` with line, position and line length; NULL for machines not on the floor.

    A name that stands in several places takes the first.  The floor is joined
    without a hint: Spark broadcasts it when its measured size allows, and splits the
    hot names of a large join otherwise.
    """
    first = _with_line_size(floor, "total_in_line") \
        .groupBy("name").agg(F.min(F.struct("line_order", "position", "line", "total_in_line")).alias("place"))
    return names.join(first, names[column] == first["name"], "left").select(
        *names.columns, F.col("place.line").alias("line"), F.col("place.position").alias("position"),
        F.col("place.total_in_line").alias("total_in_line"),
    )
