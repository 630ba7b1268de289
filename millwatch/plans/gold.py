"""Full refresh of the gold tables."""

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import schemas
from millwatch.operators.latest import newest_variants
from millwatch.plans import kpi, machine, orders
from millwatch.session import scratch_dropped, stored

# Gold table -> the inputs its plan takes before ``as_of``, and the plan.
GOLD_TABLES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "current_machine_status": (("feed",), machine.current_machine_status),
    "machine_uptime_7days": (("feed",), machine.machine_uptime),
    "problematic_machines_30days": (("feed",), machine.problematic_machines),
    "hourly_status_patterns": (("feed",), machine.hourly_status_patterns),
    "work_order_status_summary": (("work_orders",), orders.work_order_status_summary),
    "work_order_trends_30days": (("work_orders",), orders.work_order_trends),
    "machine_status_changes_7days": (("feed",), machine.machine_status_changes),
    "executive_kpis": (("feed", "work_orders"), kpi.executive_kpis),
}


# A refresh writes a version of its own; the pointer, written last, makes it the one that readers see.


def write_gold(table: DataFrame, root: str, name: str, version: str = "single") -> None:
    table.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")


def publish(spark: SparkSession, root: str, version: str) -> None:
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/_published")


def current_version(spark: SparkSession, root: str) -> str:
    """The version published last."""
    rows = spark.read.schema("version string, published_at timestamp").parquet(f"{root}/_published")
    return rows.agg(F.max_by("version", F.struct("published_at", "version"))).first()[0]


def read_gold(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    if name not in GOLD_TABLES:
        raise KeyError(f"no gold table {name}")
    return spark.read.schema(schemas.GOLD[name]).parquet(f"{root}/version={version or current_version(spark, root)}/{name}")


def refresh_gold(
    spark: SparkSession, feed: DataFrame, work_orders: DataFrame, as_of: datetime, root: str,
    variants: DataFrame | None = None,
) -> str:
    """Write all eight tables as a new version and publish it; returns the version.

    The neighbour pass over the last 30 days runs once and is stored; all
    tables but the current status read that instead of the whole history, and a
    lost executor costs no second shuffle.  ``variants``, the streamed state of the
    same history, spares the current status its scan and gives the same rows.  Refreshes
    that run at the same time, or fail, leave the published version alone.  What a refresh stores
    on the way goes with its end.
    """
    version = uuid.uuid4().hex
    with scratch_dropped(spark):
        readings = stored(machine.transitions(feed, as_of), "transitions")
        tables = {"feed": readings, "work_orders": work_orders}
        current = newest_variants(feed) if variants is None else variants
        from_readings = {
            "current_machine_status": machine.current_status_from_variants(current, as_of),
            "machine_uptime_7days": machine.uptime_from_transitions(readings, as_of),
            "problematic_machines_30days": machine.problems_from_transitions(readings, as_of),
            "machine_status_changes_7days": machine.changes_from_transitions(readings, as_of),
        }
        write_version(spark, tables, from_readings, as_of, root, version)
    return version


def write_version(spark: SparkSession, tables: dict[str, DataFrame], given: dict[str, DataFrame], as_of: datetime, root: str, version: str) -> None:
    """Write all tables, those of ``given`` as they are and the others from ``tables``, and publish them together."""
    for name, (inputs, plan) in GOLD_TABLES.items():
        write_gold(given[name] if name in given else plan(*[tables[i] for i in inputs], as_of), root, name, version)
    publish(spark, root, version)
