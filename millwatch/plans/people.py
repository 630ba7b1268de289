"""Employee and department reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch.functions.orders import CRITICAL, DONE, count_where, taken_where, with_taken
from millwatch.functions.ratios import mean_hours, percent
from millwatch.functions.times import MICROS_PER_HOUR


def active_employees(employees: DataFrame) -> DataFrame:
    """Active employees by last and first name, with the full name."""
    return (
        employees.filter("active")
        .orderBy(F.col("last_name").asc_nulls_last(), F.col("first_name").asc_nulls_last(), "id")
        .select("id", "first_name", "last_name", "email", "department", _full_name().alias("full_name"))
    )


def _full_name() -> Column:
    return F.concat("first_name", F.lit(" "), "last_name")


def orders_by_assignee(orders: DataFrame) -> DataFrame:
    """One row per assignee name, so that the join with employees never multiplies orders."""
    return (
        with_taken(orders.filter("assignee is not null"))
        .groupBy("assignee")
        .agg(
            F.count("id").alias("orders"),
            count_where("status = 'open'", "open"), count_where("status = 'in_progress'", "in_progress"),
            count_where(DONE, "completed"), count_where(f"{DONE} and {CRITICAL}", "critical_completed"),
            *taken_where(DONE),
            F.min("created_at").alias("first"), F.max("created_at").alias("last"),
        )
    )


def _with_orders(employees: DataFrame, orders: DataFrame) -> DataFrame:
    """Active employees with the totals of the orders that carry their name; namesakes share them.

    Both sides are aggregates or dimension tables; Spark picks the join by their
    measured size and splits a name shared by many employees.
    """
    people = employees.filter("active").select("id", "department", _full_name().alias("employee_name"))
    totals = orders_by_assignee(orders)
    return people.join(totals, people["employee_name"] == totals["assignee"], "left")


def _or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0).cast("bigint"))


def employee_workload(employees: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders per active employee, busiest first."""
    return (
        _with_orders(employees, orders)
        .select(
            "id", "employee_name", "department",
            _or_zero("orders").alias("total_assigned"), _or_zero("open").alias("open_assignments"),
            _or_zero("in_progress").alias("in_progress_assignments"),
            _or_zero("completed").alias("completed_assignments"),
            mean_hours("total", "timed").alias("avg_completion_hours"),
            F.col("first").alias("first_assignment"), F.col("last").alias("last_assignment"),
        )
        .orderBy(F.col("total_assigned").desc(), F.col("open_assignments").desc(), "id")
        .drop("id")
    )


def department_performance(employees: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders per department of the active employees; a department without orders sorts first."""
    return (
        _with_orders(employees, orders)
        .groupBy("department")
        .agg(
            F.countDistinct("id").alias("employee_count"),
            F.sum(_or_zero("orders")).alias("total_work_orders"),
            F.sum(_or_zero("completed")).alias("completed_orders"),
            F.sum("total").alias("total"), F.sum("timed").alias("timed"),
            F.sum(_or_zero("critical_completed")).alias("critical_resolved"),
        )
        .select(
            F.coalesce("department", F.lit(fv.UNASSIGNED)).alias("department"),
            "employee_count", "total_work_orders", "completed_orders",
            percent("completed_orders", "total_work_orders").alias("completion_rate"),
            mean_hours("total", "timed").alias("avg_resolution_hours"),
            "critical_resolved",
        )
        .orderBy(F.col("completion_rate").desc_nulls_first(), F.col("avg_resolution_hours").asc_nulls_last(),
                 "department")
    )


def employee_response_time(orders: DataFrame, at_least: int = 3) -> DataFrame:
    """Response hours per assignee with at least three started orders, quickest first."""
    kinds = {"": "true", "critical_": CRITICAL, "high_": "priority = 'high'", "normal_": "priority in ('medium', 'low')"}
    sums = [column for kind, wanted in kinds.items() for column in taken_where(wanted, kind)]
    return (
        with_taken(orders.filter("assignee is not null and status in ('in_progress', 'completed')"))
        .groupBy("assignee")
        .agg(F.count(F.lit(1)).alias("total_responded"), *sums,
             F.min("taken").alias("fastest"), F.max("taken").alias("slowest"))
        .filter(F.col("total_responded") >= at_least)
        .select(
            "assignee", "total_responded",
            *[mean_hours(f"{kind}total", f"{kind}timed").alias(f"avg_{kind}response_hours") for kind in kinds],
            F.expr(f"fastest / {MICROS_PER_HOUR}D").alias("fastest_response_hours"),
            F.expr(f"slowest / {MICROS_PER_HOUR}D").alias("slowest_response_hours"),
        )
        .orderBy(F.col("avg_response_hours").asc_nulls_last(), "assignee")
    )
