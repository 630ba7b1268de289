"""The SQL that DuckDB answers on the same tables, one statement per registered query."""

from datetime import timedelta

from checks.views import (
    AS_OF, CANDIDATES_CTE, CHANGES_CTE, EMPLOYEES_CTE, FEED_CTE, ORDERS_CTE, REPEATED, REQUESTS_CTE, SELECTED_MACHINE, TIME_FIELD,
    row_text,
)
from millwatch import schemas

NOW = f"timestamp '{AS_OF}'"
HOUR = 3_600_000_000


def day(n: int) -> str:
    return f"timestamp '{AS_OF - timedelta(days=n)}'"


def rounded(n: str, d: str, places: int = 2) -> str:
    """n / d, half away from zero, in whole numbers; NULL when d is 0."""
    s = 10 ** places
    size = f"((abs(({n})::hugeint) * {2 * s} + abs(({d})::hugeint)) // nullif(2 * abs(({d})::hugeint), 0))"
    return f"(((case when (({n}) < 0) <> (({d}) < 0) then -1 else 1 end) * {size})::bigint / {s}.0)::double"


def pct(n: str, d: str) -> str:
    return rounded(f"({n})::hugeint * 100", d)


def hours(total: str, n: str) -> str:
    return rounded(total, f"({n})::hugeint * {HOUR}")


def line(name: str) -> str:
    return (f"case when {name} like '%_01_%' then 'Line_1' when {name} like '%_02_%' then 'Line_2' "
            f"when {name} like '%_03_%' then 'Line_3' else 'Unknown' end")


def feed(body: str, *more: str) -> str:
    return f"with {', '.join([FEED_CTE, *more])} {body}"


def orders(body: str, *more: str) -> str:
    return f"with {', '.join([ORDERS_CTE, *more])} {body}"


def both(body: str, *more: str) -> str:
    return f"with {', '.join([FEED_CTE, ORDERS_CTE, *more])} {body}"


def people(body: str, *more: str) -> str:
    return f"with {', '.join([EMPLOYEES_CTE, ORDERS_CTE, *more])} {body}"


TAKEN = '(epoch_us(created_at) - epoch_us("timestamp"))'
AGE = f'(epoch_us({NOW}) - epoch_us("timestamp"))'
UPDATED = f"{NOW} as last_updated"
ORDER = "partition by machine_name order by datetime, machine_id, status"
NEWEST = ("partition by machine_name order by datetime desc nulls first, machine_id desc nulls last, "
          "status desc nulls last, type desc nulls last")


def n_where(condition: str) -> str:
    return f"count(*) filter (where {condition})"


def taken_where(condition: str) -> tuple[str, str]:
    return f"sum({TAKEN}) filter (where {condition})", f"count({TAKEN}) filter (where {condition})"


def avg_hours(condition: str) -> str:
    return hours(*taken_where(condition))


LATEST_CTE = (f"latest as (select machine_id, machine_name, status, type, datetime from machine_feed "
              f"qualify row_number() over ({NEWEST}) = 1)")

# -- gold tables --------------------------------------------------------------------------------

CURRENT_STATUS = f"""
select {line('machine_name')} as production_line, type as equipment_type, status, count(*) as machine_count,
       {pct('count(*)', 'sum(count(*)) over ()')} as percentage, {UPDATED}
from (select distinct machine_name, type, first_value(status) over ({NEWEST}) as status from machine_feed)
group by all"""

UPTIME = f"""
select {line('machine_name')} as production_line, machine_name, type,
       {pct('up', 'total')} as uptime_percentage, {rounded('up', str(HOUR))} as operational_hours,
       {rounded('total - up', str(HOUR))} as downtime_hours, {UPDATED}
from (select machine_name, type, sum(lasted) as total,
             coalesce(sum(lasted) filter (where status = 'operational'), 0) as up
      from (select *, epoch_us(coalesce(lead(datetime) over ({ORDER}), {NOW})) - epoch_us(datetime) as lasted
            from machine_feed where datetime >= {day(7)})
      group by machine_name, type)"""


def problems(as_of_days_back: str) -> str:
    return f"""
select {line('machine_name')} as production_line, machine_name, type, count(*) as downtime_incidents,
       count(distinct datetime::date) as days_with_issues, min(datetime) as first_incident,
       max(datetime) as last_incident, {UPDATED}
from (select *, lag(status) over ({ORDER}) as before from machine_feed where datetime >= {as_of_days_back})
where status = 'down' and before = 'operational'
group by machine_name, type"""


def hourly(start: str) -> str:
    down, up, warn = (n_where(f"status = '{s}'") for s in ("down", "operational", "warning"))
    return f"""
select hour(datetime)::int as hour_of_day, {up} as operational_count, {down} as down_count,
       {warn} as warning_count, count(*) as total_readings, {pct(down, 'count(*)')} as downtime_percentage,
       {pct(up, 'count(*)')} as uptime_percentage, {pct(warn, 'count(*)')} as warning_percentage, {UPDATED}
from machine_feed where datetime >= {start} group by hour(datetime)"""


STATUS_SUMMARY = f"""
select status, count(*) as order_count, {pct('count(*)', 'sum(count(*)) over ()')} as percentage,
       {avg_hours("status in ('completed', 'cancelled')")} as avg_resolution_hours,
       {n_where("priority = 'critical'")} as critical_count, {n_where('assignee is null')} as unassigned_count, {UPDATED}
from work_orders group by status"""

TRENDS = f"""
select order_date, daily_count, {rounded('total', 'seen')} as seven_day_moving_avg,
       case when 5 * daily_count * seen > 6 * total then 'High'
            when 5 * daily_count * seen < 4 * total then 'Low' else 'Normal' end as volume_indicator, {UPDATED}
from (select *, sum(daily_count) over week as total, count(*) over week as seen
      from (select created_at::date as order_date, count(*) as daily_count
            from work_orders where created_at >= {day(30)} group by 1)
      window week as (order by order_date rows between 6 preceding and current row))"""

STATUS_CHANGES = f"""
select datetime::date as status_date, hour(datetime)::int as status_hour, machine_name,
       {line('machine_name')} as production_line, type, status, before as previous_status,
       case when status = 'down' and before = 'operational' then 'FAILURE'
            when status = 'operational' and before = 'down' then 'RECOVERY' else 'STABLE' end as status_change_type,
       {UPDATED}
from (select *, lag(status) over ({ORDER}) as before from machine_feed where datetime >= {day(7)})
where before is not null"""

UNFINISHED = "status in ('open', 'in_progress')"
RECENT_DONE = f"status = 'completed' and created_at >= {day(7)}"
KPIS = f"""
select *, {UPDATED} from (
  select 'Manufacturing Overview' as metric_category, 'Total Machines' as metric_name,
         count(distinct machine_name)::double as current_value, 25.0::double as target_value, 'count' as value_type
  from machine_feed where datetime >= {day(1)}
  union all
  select 'Manufacturing Overview', 'Current Uptime %', {pct(n_where("status = 'operational'"), 'count(*)')},
         95.0::double, 'percentage'
  from (select status from machine_feed where datetime >= {day(1)} qualify row_number() over ({NEWEST}) = 1)
  union all
  select 'Work Orders', 'Open Orders', count(*)::double, 10.0::double, 'count' from work_orders where {UNFINISHED}
  union all
  select 'Work Orders', 'Critical Orders', count(*)::double, 0.0::double, 'count'
  from work_orders where priority = 'critical' and {UNFINISHED}
  union all
  select 'Performance', 'Avg Resolution Time (hours)', {avg_hours(RECENT_DONE)}, 24.0::double, 'hours' from work_orders)"""

GOLD = {
    "current_machine_status": feed(CURRENT_STATUS),
    "machine_uptime_7days": feed(UPTIME),
    "problematic_machines_30days": feed(problems(day(30))),
    "hourly_status_patterns": feed(hourly(day(30))),
    "work_order_status_summary": orders(STATUS_SUMMARY),
    "work_order_trends_30days": orders(TRENDS),
    "machine_status_changes_7days": feed(STATUS_CHANGES),
    "executive_kpis": both(KPIS),
}

GOLD_ROWS = " union all ".join(
    f'select \'{name}\' as table_name, {row_text(schemas.GOLD[name], duckdb=True)} as "row" from ({sql})' for name, sql in GOLD.items())

SOURCES = {
    "table_machine_feed": feed("select * from machine_feed"),
    "table_work_orders": orders("select * from work_orders"),
    "table_employees": people(f"select *, {NOW} as created_at from employees"),
}

# -- reports --------------------------------------------------------------------------------------

_PERIOD = f"created_at >= {day(7)}"
_DONE = "status = 'completed'"


def _period_rows() -> str:
    def pair(name: str, condition: str) -> str:
        return (f"{n_where(f'{_PERIOD} and {condition}')} as {name}_now, "
                f"{n_where(f'not ({_PERIOD}) and {condition}')} as {name}_before")

    (t_now, n_now), (t_old, n_old) = (taken_where(f"{p} and {_DONE}") for p in (_PERIOD, f"not ({_PERIOD})"))
    sums = ", ".join([pair("made", "true"), pair("done", _DONE), pair("crit", "priority = 'critical'"),
                      f"{t_now} as t_now, {n_now} as n_now, {t_old} as t_old, {n_old} as n_old"])

    def row(metric: str, name: str) -> str:
        return (f"select '{metric}' as metric, {name}_now::double as current_period, "
                f"{name}_before::double as previous_period, "
                f"{pct(f'{name}_now - {name}_before', f'{name}_before')} as percent_change from sums")

    hours_row = (f"select 'Avg Resolution Hours', {hours('t_now', 'n_now')}, {hours('t_old', 'n_old')}, "
                 f"{pct('t_now * n_old - t_old * n_now', 't_old * n_now')} from sums")
    return (f"with {ORDERS_CTE}, sums as (select {sums} from work_orders where created_at >= {day(14)}) "
            f"{row('Work Orders Created', 'made')} union all {row('Orders Completed', 'done')} "
            f"union all {hours_row} union all {row('Critical Orders', 'crit')}")


def _bucket(age: str) -> str:
    return (f"case when {age} < {24 * HOUR} then 'Less than 1 day' when {age} < {72 * HOUR} then '1-3 days' "
            f"when {age} < {168 * HOUR} then '3-7 days' when {age} < {720 * HOUR} then '1-4 weeks' "
            "else 'Over 1 month' end")


_TENTHS = f"((2 * {AGE} * 10 + {HOUR}) // (2 * {HOUR}))"


def _alert_items() -> str:
    old = f"concat({_TENTHS} // 10, '.', {_TENTHS} % 10, 'h old')"

    def item(alert: str, last: str, condition: str) -> str:
        return (f"select '{alert}' as alert_type, id as item, concat(id, ' (', machine_id, ' - ', {last}, ')') as detail "
                f"from work_orders where {condition}")

    return " union all ".join([
        item("Critical Open Work Orders", old, f"priority = 'critical' and {UNFINISHED}"),
        item("Overdue High Priority Orders", "assignee", f"priority = 'high' and {UNFINISHED} and {AGE} > {48 * HOUR}"),
        item("Unassigned Orders Over 24h", "priority", f"assignee is null and status = 'open' and {AGE} > {24 * HOUR}"),
        f"""select distinct 'Machines Down Over 4h', machine_name, machine_name from machine_feed a
            where status = 'down' and datetime >= {day(1)} and epoch_us({NOW}) - epoch_us(datetime) > {4 * HOUR}
              and not exists (from machine_feed b where b.machine_name = a.machine_name and b.status = 'operational'
                              and b.datetime > a.datetime and b.datetime >= {day(1)})""",
    ])


_ALERTS = ("(values ('Critical Open Work Orders'), ('Overdue High Priority Orders'), ('Unassigned Orders Over 24h'), "
           "('Machines Down Over 4h'))")


def exception_report() -> str:
    """One row per alert, as the statement has it: the test tables hold less than a page of any."""
    return both(
        f"""select a.alert_type, 1::bigint as page, 1::bigint as pages, count(i.item) as count, string_agg(i.detail, ', ' order by i.detail) as details
            from {_ALERTS} a(alert_type) left join items i using (alert_type) group by a.alert_type""",
        f"items as ({_alert_items()})")


_PER_ASSIGNEE = f"""by_name as (
  select first_name || ' ' || last_name as employee_name, e.id as employee_id, department, w.* exclude (id), w.id as order_id
  from employees e left join work_orders w on first_name || ' ' || last_name = w.assignee where e.active)"""

REPORTS = {
    "line_efficiency": feed(f"""
select {line('machine_name')} as production_line, count(distinct machine_name) as total_machines,
       {pct(n_where("status = 'operational'"), 'count(*)')} as efficiency_percentage,
       {n_where("status = 'operational'")} as operational_readings, {n_where("status = 'down'")} as down_readings,
       count(*) as total_readings
from machine_feed where datetime >= {day(7)} group by 1 order by 3 desc nulls first"""),
    "priority_analysis": orders(f"""
select priority, count(*) as total_orders, {n_where("status = 'open'")} as open_orders,
       {n_where("status = 'in_progress'")} as in_progress_orders, {n_where(_DONE)} as completed_orders,
       {avg_hours(_DONE)} as avg_resolution_hours,
       (max({AGE}) filter (where {UNFINISHED})) / {HOUR}.0::double as oldest_open_hours
from work_orders group by priority"""),
    "machine_order_frequency": orders(f"""
select {line('machine_id')} as production_line, machine_id, count(*) as total_orders,
       {n_where("status = 'open'")} as open_orders, {n_where("priority = 'critical'")} as critical_orders,
       {avg_hours(_DONE)} as avg_resolution_hours,
       date_diff('day', min(created_at)::date, {NOW}::date)::int as days_since_first_order,
       date_diff('day', max(created_at)::date, {NOW}::date)::int as days_since_last_order
from work_orders group by machine_id order by total_orders desc, critical_orders desc, machine_id limit 20"""),
    "work_order_aging": orders(f"""
select {_bucket(AGE)} as age_bucket, count(*) as order_count, {hours(f'sum({AGE})', 'count(*)')} as avg_age_hours,
       min(machine_id) as example_machine, min(priority) as min_priority, max(priority) as max_priority
from work_orders where {UNFINISHED} group by 1"""),
    "daily_operations": orders(f"""
select created_at::date as report_date, count(*) as total_work_orders,
       {n_where("priority = 'critical'")} as critical_orders, {n_where(_DONE)} as completed_orders,
       {pct(n_where(_DONE), 'count(*)')} as completion_rate,
       {avg_hours("status in ('in_progress', 'completed')")} as avg_response_hours,
       count(assignee) as assigned_orders, {n_where('assignee is null')} as unassigned_orders,
       count(distinct assignee) as active_assignees
from work_orders where created_at >= {day(30)} group by 1 order by 1 desc"""),
    "period_over_period": _period_rows(),
    "employee_workload": people(f"""
select employee_name, department, count(order_id) as total_assigned, {n_where("status = 'open'")} as open_assignments,
       {n_where("status = 'in_progress'")} as in_progress_assignments, {n_where(_DONE)} as completed_assignments,
       {avg_hours(_DONE)} as avg_completion_hours, min(created_at) as first_assignment, max(created_at) as last_assignment
from by_name group by employee_id, employee_name, department""", _PER_ASSIGNEE),
    "department_performance": people(f"""
select coalesce(department, 'Unassigned') as department, count(distinct employee_id) as employee_count,
       count(order_id) as total_work_orders, {n_where(_DONE)} as completed_orders,
       {pct(n_where(_DONE), 'count(order_id)')} as completion_rate, {avg_hours(_DONE)} as avg_resolution_hours,
       {n_where(f"{_DONE} and priority = 'critical'")} as critical_resolved
from by_name group by by_name.department""", _PER_ASSIGNEE),
    "employee_response_time": orders(f"""
select assignee, count(*) as total_responded, {avg_hours('true')} as avg_response_hours,
       {avg_hours("priority = 'critical'")} as avg_critical_response_hours,
       {avg_hours("priority = 'high'")} as avg_high_response_hours,
       {avg_hours("priority in ('medium', 'low')")} as avg_normal_response_hours,
       min({TAKEN}) / {HOUR}.0::double as fastest_response_hours, max({TAKEN}) / {HOUR}.0::double as slowest_response_hours
from work_orders where assignee is not null and status in ('in_progress', 'completed')
group by assignee having count(*) >= 3"""),
    "estimated_oee": both(f"""
select {line('machine_name')} as production_line, machine_name, type, {pct('up', 'readings')} as availability_percent,
       coalesce(made, 0) as work_orders_7days, coalesce(urgent, 0) as priority_orders_7days,
       coalesce({hours('taken', 'timed')}, 0.0::double) as avg_resolution_hours,
       {rounded('up::hugeint * 8075', 'readings::hugeint * 10000')} as estimated_oee_percent
from (select machine_name, type, {n_where("status = 'operational'")} as up, count(*) as readings
      from machine_feed where datetime >= {day(7)} group by 1, 2)
left join (select machine_id, count(*) as made, {n_where("priority in ('high', 'critical')")} as urgent,
                  {taken_where(_DONE)[0]} as taken, {taken_where(_DONE)[1]} as timed
           from work_orders where created_at >= {day(7)} group by 1) on machine_id = machine_name"""),
    "exception_report": exception_report(),
    "exception_items": both("select * from items", f"items as ({_alert_items()})"),
}

# -- floor ------------------------------------------------------------------------------------------


def kind(name: str) -> str:
    n = f"lower({name})"
    return (f"case when contains({n}, 'sorter') then 'sorter' when contains({n}, 'robotic') then 'robotic_arm' "
            f"when contains({n}, 'molder') then 'injection_molder' when contains({n}, 'painter') then 'painter' "
            f"when contains({n}, 'valve') then 'valve' else 'sorter' end")


def icon(name: str) -> str:
    return f"case when {kind(name)} = 'valve' then 'valve_icon.png' else {kind(name)} || '.png' end"


def short(name: str) -> str:
    p = f"string_split({name}, '_')"
    return (f"case when len({p}) >= 3 then array_to_string(list_concat(list_transform({p}[:-3], "
            f"lambda w: upper(w[1])), {p}[-2:]), '_') else {name} end")


def display(status: str) -> str:
    s = f"lower(coalesce({status}, 'unknown'))"
    return (f"case when {s} = 'operational' or contains({s}, 'running') then 'operational' "
            f"when {s} = 'warning' or contains({s}, 'caution') or contains({s}, 'warn') then 'warning' "
            f"when {s} = 'down' or contains({s}, 'error') or contains({s}, 'fault') or contains({s}, 'failed') then 'down' "
            "else 'unknown' end")


FLOOR_CTE = f"""floor as (
  select case line when 'Line_1' then 0 when 'Line_2' then 1 when 'Line_3' then 2 else 3 end::int as line_order, line,
         (row_number() over (partition by line order by name) - 1)::int as position, name
  from (select distinct machine_name as name, {line('machine_name')} as line from machine_feed))"""

LIVE_CTE = f"""live as (
  select line_order, line, position, name, {short('name')} as short_name, {kind('name')} as type, {icon('name')} as icon,
         {display('status')} as status, datetime as reported_at
  from floor left join latest on name = machine_name)"""


def live(body: str, *more: str) -> str:
    return both(body, FLOOR_CTE, LATEST_CTE, LIVE_CTE, *more)


ISO = ("strftime({c}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({c}) % 1000000 <> 0 "
       "then '.' || strftime({c}, '%f') else '' end")


def iso(column: str) -> str:
    return ISO.format(c=column)


FLOOR = {
    "floor_layout": feed(f"""
select line_order, line, position, name, {kind('name')} as type, {icon('name')} as icon,
       count(*) over (partition by line) as machine_count, count(*) over () as total_machines,
       'injection_molder,robotic_arm,sorter,painter,valve' as machine_types from floor""", FLOOR_CTE),
    "all_machines": feed("select name from floor", FLOOR_CTE),
    "next_on_line": feed("select line, position, name, lead(name) over (partition by line order by position) as next_name "
                         "from floor", FLOOR_CTE),
    "machine_type": feed(f"select machine_id, machine_name, datetime, {kind('machine_name')} as machine_type, "
                         f"{icon('machine_name')} as icon from machine_feed"),
    "machine_location": feed("select machine_name, datetime, line, position, total_in_line from machine_feed left join "
                             "(select *, count(*) over (partition by line) as total_in_line from floor) "
                             "on name = machine_name", FLOOR_CTE),
    "line_of": feed(f"""
select machine_name, {line('machine_name')} as production_line,
       case when regexp_matches(machine_name, '_\\d\\d_\\d\\d$')
            then 'Line_' || regexp_extract(machine_name, '_(\\d\\d)_\\d\\d$', 1)::int else 'Unknown' end as strict_line,
       count(*) as readings
from machine_feed group by machine_name"""),
    "machine_short_name": feed(f"select machine_name, {short('machine_name')} as short_name, count(*) as readings "
                               "from machine_feed group by machine_name"),
    "normalised_status": feed(f"select status, {display('status')} as display_status, count(*) as readings "
                              "from (select event_type as status from events union all select status from machine_feed) "
                              "group by status"),
    "live_floor": live("select * from live"),
    "work_order_candidates": live("select line, position, name, type from live where status = 'down'"),
    "work_order_candidates_without_order": live(
        f"select line, position, name, type from live where status = 'down' "
        f"and name not in (select machine_id from work_orders where {UNFINISHED})"),
}

# -- application queries ------------------------------------------------------------------------------

LISTED = (f"select id, machine_id, issue_description, priority, reporter_name, "
          f"coalesce(nullif(assignee, ''), 'Unassigned') as assignee, status, "
          f"""{iso('"timestamp"')} || '+00:00' as "timestamp", {iso('created_at')} || '+00:00' as created_at """
          "from work_orders")

API = {
    "latest_status": feed("select machine_name, status, type, datetime from latest", LATEST_CTE),
    "latest_status_json": feed(
        f"select machine_name as key, concat('{{\"status\":\"', status, '\",\"type\":\"', type, '\",\"datetime\":\"', "
        f"{iso('datetime')}, '\"}}') as value from latest", LATEST_CTE),
    "active_employees": people("select id, first_name, last_name, email, department, first_name || ' ' || last_name "
                               "as full_name from employees where active"),
    "work_order_list": orders(LISTED),
    "work_order_status_counts": orders(
        "select " + ", ".join(n_where(f"status = '{s}'") + f" as {s}" for s in ("open", "in_progress", "completed"))
        + ", count(*) as total from work_orders"),
    "work_order_filter": orders(f"select * from ({LISTED}) where status = 'in_progress' and priority = 'high' "
                                "and contains(lower(machine_id), 'robotic') and assignee = 'Unassigned'"),
    "assignee_options": orders("select distinct coalesce(nullif(assignee, ''), 'Unassigned') as assignee from work_orders"),
    "work_order_display": orders(
        "select id, machine_id as machine, case when length(issue_description) > 60 "
        "then substr(issue_description, 1, 60) || '...' else issue_description end as issue, priority, "
        "reporter_name as reporter, coalesce(nullif(assignee, ''), 'Unassigned') as assignee, status, "
        "coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), '-') as created from work_orders"),
}

# -- tiles --------------------------------------------------------------------------------------------


def cents(column: str) -> str:
    return f"round({column} * 100.0)::bigint"


def _mean(column: str) -> str:
    return f"((sum({cents(column)})::double / count({column})) / 100.0)::double"


def _sum(column: str) -> str:
    return f"(sum({cents(column)})::double / 100.0)::double"


def _tile(name: str, body: str) -> str:
    return f"select {body.replace('GOLD', f'({GOLD[name]})')}"


TILES = {
    "tile_equipment_distribution": _tile("current_machine_status",
        "equipment_type, sum(machine_count)::bigint as machine_count from GOLD group by 1"),
    "tile_average_uptime": _tile("machine_uptime_7days", f"{_mean('uptime_percentage')} as avg_uptime_percentage from GOLD"),
    "tile_operational_hours_by_machine": _tile("machine_uptime_7days",
        f"machine_name, {_sum('operational_hours')} as operational_hours from GOLD group by 1"),
    "tile_uptime_by_line": _tile("machine_uptime_7days",
        f"production_line, {_mean('uptime_percentage')} as avg_uptime_percentage from GOLD group by 1"),
    "tile_incident_count": _tile("problematic_machines_30days",
        "count(downtime_incidents) as incident_count, coalesce(sum(downtime_incidents), 0)::bigint as incidents_total from GOLD"),
    "tile_machine_count": _tile("machine_uptime_7days", "count(machine_name) as machine_count from GOLD"),
    "tile_open_order_count": _tile("work_order_status_summary",
        "count(order_count) as status_groups, coalesce(sum(order_count) filter "
        "(where status in ('open', 'in_progress')), 0)::bigint as open_orders from GOLD"),
    "tile_total_downtime": _tile("machine_uptime_7days", f"{_sum('downtime_hours')} as downtime_hours from GOLD"),
    "tile_downtime_hours_by_machine": _tile("machine_uptime_7days",
        f"machine_name, {_sum('downtime_hours')} as downtime_hours from GOLD group by 1"),
    "tile_machine_filter": _tile("machine_uptime_7days", "machine_name, count(*) as associated from GOLD group by 1"),
    "tile_machine_filter_selected": _tile("machine_uptime_7days",
        f"machine_name, {n_where(f"machine_name = '{SELECTED_MACHINE}'")} as associated from GOLD group by 1"),
}

# -- ingest and constraints -----------------------------------------------------------------------------

# request_key -> first error, from the way the requests are made
_ERROR = """case when k % 37 = 0 then 'request is not a JSON object'
     when k % 11 = 0 or k % 13 = 0 or k % 43 = 0 or k % 47 = 0 then 'machine_id is required'
     when k % 17 = 0 or k % 53 = 0 then 'issue_description is required'
     when k % 23 = 0 or k % 59 = 0 then 'reporter_name is required'
     when k % 5 <> 0 and (k % 29 = 0 or k % 31 = 0) then 'priority is not allowed'
     when k % 41 = 0 then 'reporter_name is longer than 100' end"""
_ASKED = f"asked as (select *, {_ERROR} as error from (select *, substr(id, 4)::bigint as k from work_orders))"

ACCEPTED = orders(f"""
select 'WO-20240131-' || substr(sha256(k::varchar), 1, 32) as id, machine_id, issue_description,
       case when k % 5 = 0 then 'medium' else priority end as priority, reporter_name, case when k % 61 = 0 then '' else coalesce(assignee, '') end as assignee,
       {NOW} as "timestamp", {NOW} as created_at, 'open' as status from asked where error is null""", _ASKED)
REJECTED = orders("select request_key, raw, error from requests join asked on k = request_key where error is not null "
                  "union all select request_key, raw, 'id already exists' from requested join asked on k = request_key "
                  f"where error is null and {REPEATED}", REQUESTS_CTE, _ASKED)

_BROKEN_ROWS = {
    "machine_id not null": "machine_id is null",
    "priority allowed": "priority = 'urgent'",
    "status allowed": "status = 'paused'",
    "reporter_name length": "length(reporter_name) > 100",
}

INGEST = {
    "ingest_accepted": ACCEPTED,
    "ingest_rejected": REJECTED,
    "ingest_defaults": people(f"""
select id, first_name, last_name, email, department, coalesce(case when department is null then null else active end, true)
       as active, {NOW} as created_at from employees"""),
    "constraint_violations": both("""
select 'machine_feed' as "table", 'machine_id unique' as rule, machine_id::varchar as key, count(*) as count
from machine_feed group by machine_id having count(*) > 1
union all
select 'employees', 'email unique', email, count(*) from employees group by email having count(*) > 1
union all
select 'work_orders', 'id unique', id, count(*) from candidates group by id having count(*) > 1
union all
""" + " union all ".join(
        f"select 'work_orders', '{rule}', null, count(*) from candidates where {where} having count(*) > 0"
        for rule, where in _BROKEN_ROWS.items()), CANDIDATES_CTE, EMPLOYEES_CTE),
    "constraint_violating_rows": orders("""
select id, created_at, broken_rules from (select id, created_at, concat_ws(', ', """ + ", ".join(
        f"case when {where} then '{rule}' end" for rule, where in _BROKEN_ROWS.items())
        + """, case when count(*) over (partition by id) > 1 then 'id unique' end) as broken_rules from candidates)
where broken_rules <> ''""", CANDIDATES_CTE),
}

# -- changes and streams ----------------------------------------------------------------------------------


def _json_text(column: str) -> str:
    return f"""coalesce('"' || {column} || '"', 'null')"""


def _image(prefix: str = "") -> str:
    f = lambda c: f"{prefix}{c}"
    return (f"""concat('{{"machine_id":', coalesce({f('machine_id')}::varchar, 'null'), ',"machine_name":', """
            f"""{_json_text('machine_name')}, ',"status":', {_json_text(f('status'))}, ',"type":', """
            f"""{_json_text(f('type'))}, ',"datetime":', {_json_text(iso(f('datetime')))}, '}}')""")


def _epoch(column: str) -> str:
    return f"concat(epoch_us({column}) // 1000000, '.', lpad((epoch_us({column}) % 1000000)::varchar, 6, '0'))"


_BEFORE = ", ".join(f"lag({c}) over arrival as before_{c}" for c in ("seq", "machine_id", "status", "type", "datetime"))
_ENVELOPES = f"""envelopes as (
  select seq, machine_name, case when before_seq is null then 'INSERT' else 'UPDATE' end as operation,
         concat('{{"operation":"', case when before_seq is null then 'INSERT' else 'UPDATE' end,
                '","table":"machine_feed_stream","timestamp":', {_epoch('changed_at')}, ',"new_data":', {_image()},
                ',"old_data":', case when before_seq is null then 'null' else {_image('before_')} end, '}}') as value
  from (select *, {_BEFORE} from changes window arrival as (partition by machine_name order by seq)))"""


def _changes(body: str, *more: str) -> str:
    return f"with {', '.join([CHANGES_CTE, _ENVELOPES, *more])} {body}"


def _latest_of(where: str) -> str:
    return (f"select machine_id, machine_name, status, type, datetime from machine_feed where {where} "
            f"qualify row_number() over ({NEWEST}) = 1")


_SNAPSHOT_COLUMNS = ("machine_id", "machine_name", "status", "type", "datetime")
SNAPSHOT_DIFF = feed(f"""
select coalesce(n.machine_name, o.machine_name) as machine_name,
       case when n.machine_name is null then 'DELETE' when o.machine_name is null then 'INSERT' else 'UPDATE' end as operation,
       o.status as old_status, n.status as new_status, o.datetime as old_datetime, n.datetime as new_datetime
from old_rows o full join new_rows n on o.machine_name = n.machine_name
where (o.machine_id, o.status, o.type, o.datetime) is distinct from (n.machine_id, n.status, n.type, n.datetime)""",
    f"old_rows as ({_latest_of(f'datetime < {day(1)}')})", f"new_rows as ({_latest_of(f'datetime >= {day(7)}')})")

STATUS_UPDATE = both(f"""
select machine_id, machine_name, status, type, datetime
from (from latest union all
      select l.machine_id, l.machine_name, 'down', l.type, w.created_at
      from work_orders w join latest l on l.machine_name = w.machine_id
      where w.priority = 'critical' and w.status = 'open')
qualify row_number() over ({NEWEST}) = 1""", LATEST_CTE)

_MESSAGES = ("said as (select e.value, c.status from envelopes e join changes c on c.seq = e.seq), "
             "messages as (select value, true as whole from said union all "
             "select substr(value, 1, 40), false from said where status = 'warning' union all "
             f"select regexp_replace(value, '{TIME_FIELD}', '\"datetime\":null', 'g'), true from said where status = 'warning' union all "
             f"select regexp_replace(value, '{TIME_FIELD}', '\"datetime\":\"garbage\"', 'g'), false from said where status = 'down')")

STREAMS = {
    "change_envelopes": _changes("select seq, machine_name, operation, value from envelopes"),
    "snapshot_diff": SNAPSHOT_DIFF,
    "status_update": STATUS_UPDATE,
    "stream_change_envelopes": _changes("select seq, value from envelopes"),
    "stream_latest": feed("select * from latest", LATEST_CTE),
    "stream_status_changes_7days": feed(STATUS_CHANGES),
    "stream_hourly_counts": _changes("""
select date_trunc('hour', datetime) as hour, count(*) filter (status = 'operational') as operational_count,
       count(*) filter (status = 'down') as down_count, count(*) filter (status = 'warning') as warning_count,
       count(*) as total_readings, count(*) filter (seq % 500 = 0 and datetime < timestamp '2024-01-16') as late_readings
from changes where datetime is not null group by all"""),
    "stream_history": feed("select *, datetime::date as event_date from machine_feed union all "
                           "select * replace (null as datetime), null from machine_feed where status = 'warning'"),
    "stream_live_floor": live("select * from live"),
    "stream_message_log": _changes("select value from messages", _MESSAGES),
    "stream_dead_letters": _changes("select value from messages where not whole", _MESSAGES),
    "stream_down_alerts": feed("select * from machine_feed where status = 'down'"),
    "work_order_append": ACCEPTED,
}

# The batches together break what all rows break.
INGEST["constraint_violations_by_batch"] = INGEST["constraint_violations"]

# Other ways to the same rows.
LAYOUTS = {
    "latest_status_from_summaries": API["latest_status"],
    **{name: GOLD[name.rsplit("_", 1)[0]] for name in (
        "machine_uptime_7days_clustered", "problematic_machines_30days_clustered", "machine_status_changes_7days_clustered")},
    "current_machine_status_from_summaries": GOLD["current_machine_status"],
}
