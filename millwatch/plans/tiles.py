"""Dashboard tiles: small aggregates over the gold tables.

The averaged and summed columns have two digits; they add up in hundredths, so
the result does not depend on the order of the rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.functions.ratios import mean_of_cents, sum_of_cents


def only_machine(gold: DataFrame, machine_name: str | None) -> DataFrame:
    """The dashboard's machine filter; nothing selected keeps all."""
    return gold if machine_name is None else gold.filter(F.col("machine_name") == machine_name)


def equipment_distribution(status: DataFrame) -> DataFrame:
    return status.groupBy("equipment_type").agg(F.sum("machine_count").alias("machine_count"))


def average_uptime(uptime: DataFrame, machine_name: str | None = None) -> DataFrame:
    return only_machine(uptime, machine_name).agg(mean_of_cents("uptime_percentage").alias("avg_uptime_percentage"))


def _hours_by_machine(uptime: DataFrame, column: str) -> DataFrame:
    return (
        uptime.groupBy("machine_name").agg(sum_of_cents(column).alias(column))
        .orderBy(F.col(column).desc_nulls_last(), "machine_name")
    )


def operational_hours_by_machine(uptime: DataFrame, machine_name: str | None = None) -> DataFrame:
    return _hours_by_machine(only_machine(uptime, machine_name), "operational_hours")


def uptime_by_line(uptime: DataFrame, machine_name: str | None = None) -> DataFrame:
    return (
        only_machine(uptime, machine_name).groupBy("production_line")
        .agg(mean_of_cents("uptime_percentage").alias("avg_uptime_percentage"))
        .orderBy(F.col("avg_uptime_percentage").desc_nulls_last(), "production_line")
    )


def incident_count(problems: DataFrame) -> DataFrame:
    """The tile counts machines; ``incidents_total`` is the number of incidents."""
    return problems.agg(F.count("downtime_incidents").alias("incident_count"),
                        F.coalesce(F.sum("downtime_incidents"), F.lit(0).cast("bigint")).alias("incidents_total"))


def machine_count(uptime: DataFrame, machine_name: str | None = None) -> DataFrame:
    """Titled "work orders" on the dashboard, but it counts the machines of the uptime table."""
    return only_machine(uptime, machine_name).agg(F.count("machine_name").alias("machine_count"))


def open_order_count(summary: DataFrame) -> DataFrame:
    """The tile counts status groups; ``open_orders`` is the number of unfinished orders."""
    unfinished = F.when(F.col("status").isin("open", "in_progress"), F.col("order_count"))
    return summary.agg(F.count("order_count").alias("status_groups"),
                       F.coalesce(F.sum(unfinished), F.lit(0).cast("bigint")).alias("open_orders"))


def total_downtime(uptime: DataFrame, machine_name: str | None = None) -> DataFrame:
    return only_machine(uptime, machine_name).agg(sum_of_cents("downtime_hours").alias("downtime_hours"))


def downtime_hours_by_machine(uptime: DataFrame, machine_name: str | None = None) -> DataFrame:
    return _hours_by_machine(only_machine(uptime, machine_name), "downtime_hours")


def machine_filter_values(uptime: DataFrame, machine_name: str | None = None) -> DataFrame:
    """Choices of the machine filter, with how many rows the current selection leaves of each."""
    kept = F.lit(True) if machine_name is None else F.col("machine_name") == machine_name
    return uptime.groupBy("machine_name").agg(F.count_if(kept).alias("associated")).orderBy("machine_name")
