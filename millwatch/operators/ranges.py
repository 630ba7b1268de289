"""Rows in order, cut into ranges of like size: places and neighbours without a task per group.

A window over a whole group puts the group into one task.  Here the rows are dealt
out by ranges of (group, order), so a busy group, or a burst inside it, spreads over as
many ranges as its rows fill.  The ranges are written to the shared scratch folder with
their number: what follows reads the same ranges however often it is computed.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwatch.session import stored

RANGE = "_range"


def in_ranges(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the number of their range; ranges ascend with ``columns``, NULLs first."""
    return stored(rows.repartitionByRange(*columns).withColumn(RANGE, F.spark_partition_id()), "ranges")


def with_start(rows: DataFrame, group: str, order: list[str], weight: str | None = None, name: str = "start") -> DataFrame:
    """How much of the group comes before each row: rows, or the sum of ``weight``; from 0.

    Rows equal in ``group`` and all of ``order`` must not occur twice.  NULL groups are one group.
    """
    size = F.col(weight) if weight else F.lit(1).cast("bigint")
    placed = in_ranges(rows, [group, *order])
    inside = Window.partitionBy(RANGE, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group.
    ranges = placed.groupBy(RANGE, group).agg(F.sum(size).alias("_size")).select(
        F.col(RANGE).alias("_r"), F.col(group).alias("_g"),
        F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy(RANGE).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    counted = placed.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    found = counted.join(ranges, (F.col(RANGE) == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return found.select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name))
