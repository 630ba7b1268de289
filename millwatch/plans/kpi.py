"""OEE, alerts and executive KPIs."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch.functions.machines import line_of
from millwatch.functions.orders import CRITICAL, DONE, UNFINISHED, count_where, taken_where, with_taken
from millwatch.functions.ratios import mean_hours, percent, ratio, scaled_ratio
from millwatch.functions.times import MICROS_PER_HOUR, at, day_start, micros_between, since
from millwatch.operators.latest import latest_readings
from millwatch.operators.ranges import with_start


def estimated_oee(feed: DataFrame, orders: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Availability, recent orders and estimated effectiveness per machine.

    Both sides are aggregated per machine before they meet.
    """
    machines = (
        since(feed, "datetime", as_of, days)
        .groupBy("machine_name", "type")
        .agg(count_where("status = 'operational'", "up"), F.count(F.lit(1)).alias("readings"))
    )
    impact = (
        with_taken(since(orders, "created_at", as_of, days))
        .groupBy("machine_id")
        .agg(F.count(F.lit(1)).alias("orders"), count_where("priority in ('high', 'critical')", "urgent"),
             *taken_where(DONE))
    )
    return (
        machines.join(impact, machines["machine_name"] == impact["machine_id"], "left")
        .select(
            line_of(F.col("machine_name")).alias("production_line"), "machine_name", "type",
            percent("up", "readings").alias("availability_percent"),
            F.expr("coalesce(orders, 0L)").alias("work_orders_7days"),
            F.expr("coalesce(urgent, 0L)").alias("priority_orders_7days"),
            F.coalesce(mean_hours("total", "timed"), F.lit(0.0)).alias("avg_resolution_hours"),
            ratio(f"(cast(up as decimal(38,0)) * {fv.OEE_FACTOR_PER_10000})", "(cast(readings as decimal(38,0)) * 10000)")
            .alias("estimated_oee_percent"),
        )
        .orderBy(F.col("estimated_oee_percent").desc_nulls_first(), "production_line",
                 F.col("machine_name").asc_nulls_last(), "type")
    )


# -- alerts -----------------------------------------------------------------------------------


def _aged(orders: DataFrame, as_of: datetime) -> DataFrame:
    """Unfinished orders with their ``age``: the only ones that raise alerts."""
    return orders.filter(UNFINISHED).withColumn("age", micros_between(F.col("timestamp"), at(as_of)))


# Alert -> (condition on an aged order, last part of its text)
_ORDER_ALERTS = {
    fv.ALERT_CRITICAL: (CRITICAL, "hours_old"),
    fv.ALERT_OVERDUE: (f"priority = 'high' and age > {fv.OVERDUE_HOURS * MICROS_PER_HOUR}", "assignee"),
    fv.ALERT_UNASSIGNED: (
        f"assignee is null and status = 'open' and age > {fv.UNASSIGNED_HOURS * MICROS_PER_HOUR}", "priority"),
}


def machines_down(feed: DataFrame, as_of: datetime) -> DataFrame:
    """Machines down for more than four hours with no operational reading since, within the last day.

    "No later operational reading" needs only the newest of each kind, so one
    hash aggregate replaces the range anti-join.
    """
    long_ago = at(as_of - timedelta(hours=fv.DOWN_HOURS))
    fell = (F.col("status") == "down") & (F.col("datetime") < long_ago)
    return (
        since(feed, "datetime", as_of, 1)
        .filter(F.col("machine_name").isNotNull() & F.col("status").isin("down", "operational"))
        .groupBy("machine_name")
        .agg(
            F.max(F.when(fell, F.col("datetime"))).alias("down_at"),
            F.max(F.when(F.col("status") == "operational", F.col("datetime"))).alias("up_at"),
        )
        .filter(F.col("down_at").isNotNull() & (F.col("up_at").isNull() | (F.col("down_at") >= F.col("up_at"))))
        .select("machine_name")
    )


def exception_items(orders: DataFrame, feed: DataFrame, as_of: datetime) -> DataFrame:
    """Every alert item as a row: ``alert_type, item, detail``.  One scan of the orders covers three alerts.

    ``concat_ws`` leaves NULL parts out of a text.
    """
    raised = ", ".join(
        f"if({condition}, named_struct('alert_type', '{alert}', 'item', id, "
        f"'detail', concat_ws('', id, ' (', machine_id, ' - ', {last}, ')')), null)"
        for alert, (condition, last) in _ORDER_ALERTS.items()
    )
    hours_old = "concat(if(tenths < 0, '-', ''), abs(tenths) div 10, '.', abs(tenths) % 10, 'h old')"
    from_orders = (
        _aged(orders, as_of)
        .withColumn("tenths", scaled_ratio("age", MICROS_PER_HOUR, 1))
        .withColumn("hours_old", F.expr(f"if({CRITICAL}, {hours_old}, null)"))
        .select(F.inline(F.expr(f"array_compact(array({raised}))")))
    )
    from_machines = machines_down(feed, as_of).select(
        F.lit(fv.ALERT_DOWN).alias("alert_type"), F.col("machine_name").alias("item"),
        F.col("machine_name").alias("detail"))
    return from_orders.unionByName(from_machines)


ALERTS = [*_ORDER_ALERTS, fv.ALERT_DOWN]


def exception_report(orders: DataFrame, feed: DataFrame, as_of: datetime, page: int = 100_000) -> DataFrame:
    """Alerts with their count and a text of their items, ``page`` items to a row.

    (alert_type, page) is the key at every size: an alert has ``pages`` rows, numbered
    from 1, each with the count of the whole alert; an alert without items has one row
    without a text.  Items go in the order of their texts.  Equal items are counted
    before they are put in order, and the order comes from ranges, so neither an alert
    with very many items nor an item with very many copies fills one task.
    """
    items = exception_items(orders, feed, as_of).groupBy("alert_type", "detail", "item").agg(F.count(F.lit(1)).alias("n"))
    placed = with_start(items, "alert_type", ["detail", "item"], weight="n")
    counted = placed.groupBy("alert_type").agg(F.sum("n").alias("count"))
    last = "(start + n - 1)"
    share = f"(least({last}, _page * {page} + {page - 1}) - greatest(start, _page * {page}) + 1)"
    texts = (
        placed.select("alert_type", "detail", "item", "start", "n",
                      F.explode(F.expr(f"sequence(start div {page}, {last} div {page})")).alias("_page"))
        .select("alert_type", "detail", "item", "_page",
                F.expr(f"if(n = 1, detail, array_join(array_repeat(detail, cast({share} as int)), ', '))").alias("text"))
        .groupBy("alert_type", (F.col("_page") + 1).alias("page"))
        .agg(F.expr("listagg(text, ', ') within group (order by detail, item)").alias("details"))
    )
    names = orders.sparkSession.createDataFrame([(name,) for name in ALERTS], "alert_type string")
    return (
        names.join(counted, "alert_type", "left").join(texts, "alert_type", "left")
        .select("alert_type", F.coalesce("page", F.lit(1)).cast("bigint").alias("page"),
                F.greatest(F.ceil(F.coalesce("count", F.lit(0)) / F.lit(page)), F.lit(1)).cast("bigint").alias("pages"),
                F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "details")
    )


# -- KPIs -------------------------------------------------------------------------------------


def _kpi(fixed: tuple, value: Column) -> Column:
    category, name, target, kind = fixed
    return F.struct(
        F.lit(category).alias("metric_category"), F.lit(name).alias("metric_name"),
        value.cast("double").alias("current_value"), F.lit(target).alias("target_value"),
        F.lit(kind).alias("value_type"),
    )


def executive_kpis(feed: DataFrame, orders: DataFrame, as_of: datetime) -> DataFrame:
    """Five KPIs from one scan of each table.  Uptime without any reading is NULL."""
    machines = latest_readings(since(feed, "datetime", as_of, 1)).agg(
        F.count("machine_name").alias("machines"), F.count(F.lit(1)).alias("seen"),
        count_where("status = 'operational'", "up"),
    ).select(F.inline(F.array(_kpi(fv.KPI_MACHINES, F.col("machines")), _kpi(fv.KPI_UPTIME, percent("up", "seen")))))

    recent = f"{DONE} and created_at >= timestamp_ntz'{day_start(as_of, 7)}'"
    work = with_taken(orders).agg(
        count_where(UNFINISHED, "open"), count_where(f"{UNFINISHED} and {CRITICAL}", "critical"), *taken_where(recent),
    ).select(F.inline(F.array(
        _kpi(fv.KPI_OPEN, F.col("open")), _kpi(fv.KPI_CRITICAL, F.col("critical")),
        _kpi(fv.KPI_RESOLUTION, mean_hours("total", "timed")),
    )))
    return machines.unionByName(work).select("*", at(as_of).alias("last_updated"))
