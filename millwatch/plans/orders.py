"""Work-order lists and reports."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch.functions.machines import line_of
from millwatch.functions.orders import CRITICAL, DONE, UNFINISHED, count_where, taken_where, with_taken
from millwatch.functions.ratios import mean_hours, percent, ratio
from millwatch.functions.times import MICROS_PER_HOUR, at, day_start, iso_text, micros_between, since, sum_micros


# -- lists ------------------------------------------------------------------------------------


def or_unassigned(assignee: Column) -> Column:
    return F.when(F.coalesce(assignee, F.lit("")) == "", fv.UNASSIGNED).otherwise(assignee)


def work_order_list(orders: DataFrame) -> DataFrame:
    """All orders, newest first.  The id breaks ties, so that equal times sort across tasks."""
    return (
        orders.orderBy(F.col("created_at").desc_nulls_first(), "id")
        .select(
            "id", "machine_id", "issue_description", "priority", "reporter_name",
            or_unassigned(F.col("assignee")).alias("assignee"), "status",
            iso_text(F.col("timestamp"), "+00:00").alias("timestamp"),
            iso_text(F.col("created_at"), "+00:00").alias("created_at"),
        )
    )


def work_order_status_counts(orders: DataFrame) -> DataFrame:
    """One row: open, in progress and completed counts, and the total (cancelled included)."""
    status = F.lower(F.replace(F.col("status"), F.lit(" "), F.lit("_")))
    return orders.agg(
        *[F.count_if(status == s).alias(s) for s in ("open", "in_progress", "completed")],
        F.count(F.lit(1)).alias("total"),
    )


def work_order_filter(
    listed: DataFrame, status: str = "", priority: str = "", machine: str = "", assignee: str = "",
) -> DataFrame:
    """Rows of the order list that meet every given filter; an empty filter passes all.

    ``_`` and blank count as ``-`` in the status, so that the choice
    ``in-progress`` finds ``in_progress``.
    """
    if status:
        listed = listed.filter(F.lower(F.translate(F.col("status"), "_ ", "--")) == status)
    if priority:
        listed = listed.filter(F.lower("priority") == priority)
    if machine:
        listed = listed.filter(F.lower("machine_id").contains(machine.lower()))
    if assignee:
        listed = listed.filter(F.col("assignee") == assignee)
    return listed


def assignee_options(orders: DataFrame) -> DataFrame:
    return orders.select(or_unassigned(F.col("assignee")).alias("assignee")).distinct().orderBy("assignee")


def work_order_display(orders: DataFrame, width: int = 60, pattern: str = "yyyy-MM-dd HH:mm") -> DataFrame:
    """Rows as the order table shows them: long descriptions cut, a dash for a missing time."""
    text = F.col("issue_description")
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
    return (
        orders.orderBy(F.col("created_at").desc_nulls_first(), "id")
        .select(
            "id", F.col("machine_id").alias("machine"), cut.alias("issue"), "priority",
            F.col("reporter_name").alias("reporter"), or_unassigned(F.col("assignee")).alias("assignee"), "status",
            F.coalesce(F.date_format("created_at", pattern), F.lit("-")).alias("created"),
        )
    )


# -- reports ----------------------------------------------------------------------------------


def work_order_status_summary(orders: DataFrame, as_of: datetime) -> DataFrame:
    counted = (
        with_taken(orders)
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            *taken_where("status in ('completed', 'cancelled')"),
            count_where(CRITICAL, "critical_count"),
            count_where("assignee is null", "unassigned_count"),
        )
    )
    return counted.select(
        "status", "order_count",
        percent("order_count", "sum(order_count) over ()").alias("percentage"),
        mean_hours("total", "timed").alias("avg_resolution_hours"),
        "critical_count", "unassigned_count",
        at(as_of).alias("last_updated"),
    )


def work_order_trends(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Orders per day against the average of the last seven days that have orders.

    The window without partition sees one row per day, whatever the volume.
    """
    daily = (
        since(orders, "created_at", as_of, days)
        .groupBy(F.to_date("created_at").alias("order_date"))
        .agg(F.count(F.lit(1)).alias("daily_count"))
    )
    week = Window.partitionBy().orderBy("order_date").rowsBetween(-6, Window.currentRow)
    windowed = daily.select(
        "order_date", "daily_count",
        F.sum("daily_count").over(week).alias("total"), F.count(F.lit(1)).over(week).alias("seen"),
    )
    # 1.2 and 0.8 times the unrounded average, in whole numbers
    return windowed.select(
        "order_date", "daily_count",
        ratio("total", "seen").alias("seven_day_moving_avg"),
        F.expr("case when 5 * daily_count * seen > 6 * total then 'High' "
               "when 5 * daily_count * seen < 4 * total then 'Low' else 'Normal' end").alias("volume_indicator"),
        at(as_of).alias("last_updated"),
    )


def priority_analysis(orders: DataFrame, as_of: datetime) -> DataFrame:
    """Orders by priority, most severe first."""
    counted = (
        with_taken(orders)
        .groupBy("priority")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            count_where("status = 'open'", "open_orders"),
            count_where("status = 'in_progress'", "in_progress_orders"),
            count_where(DONE, "completed_orders"),
            *taken_where(DONE),
            F.expr(f"min(if({UNFINISHED}, timestamp, null))").alias("oldest"),
        )
    )
    rank = F.array_position(F.array(*map(F.lit, fv.PRIORITY_REPORT_ORDER)), F.col("priority"))
    return (
        counted.orderBy(F.nullif(rank, F.lit(0).cast("bigint")).asc_nulls_last(), "priority")
        .select(
            "priority", "total_orders", "open_orders", "in_progress_orders", "completed_orders",
            mean_hours("total", "timed").alias("avg_resolution_hours"),
            (micros_between(F.col("oldest"), at(as_of)) / F.lit(float(MICROS_PER_HOUR))).alias("oldest_open_hours"),
        )
    )


def machine_order_frequency(orders: DataFrame, as_of: datetime, top: int = 20) -> DataFrame:
    """The ``top`` machines by number of orders."""
    today = F.lit(as_of.date())
    return (
        with_taken(orders)
        .groupBy("machine_id")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            count_where("status = 'open'", "open_orders"),
            count_where(CRITICAL, "critical_orders"),
            *taken_where(DONE),
            F.min("created_at").alias("first"), F.max("created_at").alias("last"),
        )
        .orderBy(F.col("total_orders").desc(), F.col("critical_orders").desc(), "machine_id")
        .limit(top)
        .select(
            line_of(F.col("machine_id")).alias("production_line"), "machine_id",
            "total_orders", "open_orders", "critical_orders",
            mean_hours("total", "timed").alias("avg_resolution_hours"),
            F.datediff(today, F.to_date("first")).alias("days_since_first_order"),
            F.datediff(today, F.to_date("last")).alias("days_since_last_order"),
        )
    )


def work_order_aging(orders: DataFrame, as_of: datetime) -> DataFrame:
    """Unfinished orders by age.

    Machine and priority are grouping keys of the first step: a MIN over text
    would force a sort of all rows, over numbers it is a hash aggregate.
    """
    limits = " ".join(f"when age < {hours * MICROS_PER_HOUR} then '{name}'" for hours, name in fv.AGE_BUCKETS)
    fine = (
        orders.filter(UNFINISHED)
        .select("machine_id", "priority", micros_between(F.col("timestamp"), at(as_of)).alias("age"))
        .groupBy(F.expr(f"case {limits} else '{fv.OLDEST_BUCKET}' end").alias("age_bucket"), "machine_id", "priority")
        .agg(F.count(F.lit(1)).alias("n"), F.count("age").alias("aged"),
             sum_micros("age").alias("total"), F.min("age").alias("youngest"))
    )
    return (
        fine.groupBy("age_bucket")
        .agg(
            F.sum("n").alias("order_count"), F.sum("aged").alias("aged"),
            F.sum("total").alias("total"), F.min("youngest").alias("youngest"),
            F.min("machine_id").alias("example_machine"),
            F.min("priority").alias("min_priority"), F.max("priority").alias("max_priority"),
        )
        .orderBy("youngest")
        .select("age_bucket", "order_count", mean_hours("total", "aged").alias("avg_age_hours"),
                "example_machine", "min_priority", "max_priority")
    )


def daily_operations(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Orders by day of creation, newest day first."""
    counted = (
        with_taken(since(orders, "created_at", as_of, days))
        .groupBy(F.to_date("created_at").alias("report_date"))
        .agg(
            F.count(F.lit(1)).alias("total_work_orders"),
            count_where(CRITICAL, "critical_orders"),
            count_where(DONE, "completed_orders"),
            *taken_where("status in ('in_progress', 'completed')"),
            F.count("assignee").alias("assigned_orders"),
            count_where("assignee is null", "unassigned_orders"),
            F.countDistinct("assignee").alias("active_assignees"),
        )
    )
    return counted.orderBy(F.col("report_date").desc()).select(
        "report_date", "total_work_orders", "critical_orders", "completed_orders",
        percent("completed_orders", "total_work_orders").alias("completion_rate"),
        mean_hours("total", "timed").alias("avg_response_hours"),
        "assigned_orders", "unassigned_orders", "active_assignees",
    )


def period_over_period(orders: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """The last ``days`` days against the ``days`` before, from one scan."""
    now = f"created_at >= timestamp_ntz'{day_start(as_of, days)}'"
    sums = []
    for side, inside in {"now": now, "before": f"not ({now})"}.items():
        sums += [
            count_where(inside, f"made_{side}"), count_where(f"{inside} and {DONE}", f"done_{side}"),
            count_where(f"{inside} and {CRITICAL}", f"critical_{side}"),
            *taken_where(f"{inside} and {DONE}", f"{side}_"),
        ]
    one = with_taken(since(orders, "created_at", as_of, 2 * days)).agg(*sums)

    def row(metric: str, current: Column, previous: Column, change: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), current.cast("double").alias("current_period"),
            previous.cast("double").alias("previous_period"), change.alias("percent_change"),
        )

    def counts(metric: str, name: str) -> Column:
        current, previous = f"{name}_now", f"{name}_before"
        return row(metric, F.col(current), F.col(previous), percent(f"({current} - {previous})", previous))

    # the change of the unrounded means, multiplied out to stay in whole numbers
    crossed = ("(now_total * cast(before_timed as decimal(38,0)) - before_total * cast(now_timed as decimal(38,0)))",
               "(before_total * cast(now_timed as decimal(38,0)))")
    hours = row("Avg Resolution Hours", mean_hours("now_total", "now_timed"), mean_hours("before_total", "before_timed"),
                percent(*crossed))
    return one.select(F.explode(F.array(
        counts("Work Orders Created", "made"), counts("Orders Completed", "done"),
        hours, counts("Critical Orders", "critical"),
    )).alias("row")).select("row.*")
