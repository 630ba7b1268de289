"""Pieces of the work-order aggregates.  Conditions are SQL texts over the order columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.functions.times import micros_between, sum_micros

UNFINISHED = "status in ('open', 'in_progress')"
DONE = "status = 'completed'"
CRITICAL = "priority = 'critical'"


def with_taken(orders: DataFrame) -> DataFrame:
    """Adds ``taken``, the time from the report to the stored order: what the reports call resolution time."""
    return orders.withColumn("taken", micros_between(F.col("timestamp"), F.col("created_at")))


def count_where(condition: str, name: str) -> Column:
    return F.expr(f"count_if({condition})").alias(name)


def taken_where(condition: str, prefix: str = "") -> list[Column]:
    """``<prefix>total`` and ``<prefix>timed``: sum and number of the times of the orders that meet the condition."""
    taken = f"if({condition}, taken, null)"
    return [sum_micros(taken).alias(f"{prefix}total"), F.expr(f"count({taken})").alias(f"{prefix}timed")]
