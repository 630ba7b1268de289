"""The test tables seen as machine history, work orders and employees.

Each view is a list of select expressions shared by both engines; ``{mins:…}``
and the few other differences are filled in per dialect.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 31)

# A machine that exists at every scale, for the dashboard's single-select filter.
SELECTED_MACHINE = "Painter_i_01_09"

_LABEL = ("case {k} % 5 when 0 then 'Sorter' when 1 then 'Robotic_Arm' when 2 then 'Injection_Molder' "
          "when 3 then 'Painter' else 'Valve' end")


def _name(k: str) -> str:
    # the number is spelled in letters, so that no digit pair of it looks like a line
    return (f"concat({_LABEL.format(k=k)}, '_', translate(cast({k} as STRING), '0123456789', 'abcdefghij'), "
            f"'_0', cast({k} % 4 + 1 as STRING), '_0', cast({k} % 9 + 1 as STRING))")


_REPORTED = "o_orderdate + interval '8217' day + MINS(o_orderkey * 7919 % 1440)"

FEED_COLUMNS = [
    "cast(user_id as int) as machine_id",
    f"{_name('user_id')} as machine_name",
    "case event_type when 'error' then 'down' when 'signup' then 'warning' else 'operational' end as status",
    "case user_id % 5 when 0 then 'sorter' when 1 then 'robotic_arm' when 2 then 'injection_molder' "
    "when 3 then 'painter' else 'valve' end as type",
    "ts as datetime",
]

ORDER_COLUMNS = [
    "concat('WO-', cast(o_orderkey as STRING)) as id",
    f"{_name('(o_custkey % 100)')} as machine_id",
    "concat('Issue reported on order ', cast(o_orderkey as STRING)) as issue_description",
    "case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' "
    "when '3-MEDIUM' then 'medium' else 'low' end as priority",
    "concat('Reporter ', cast(o_custkey % 50 as STRING)) as reporter_name",
    "case when o_custkey % 7 = 0 then null when o_custkey % 7 = 1 then '' "
    "else concat('First', cast(o_custkey % 12 as STRING), ' Last', cast(o_custkey % 12 % 5 as STRING)) end as assignee",
    f"{_REPORTED} as timestamp",
    "least(o_orderdate + interval '8217' day + MINS(o_orderkey * 7919 % 1440 + o_orderkey * 31 % 4320), "
    "TS'2024-01-31 00:00:00') as created_at",
    "case when o_orderkey % 20 = 0 then 'cancelled' when o_orderstatus = 'O' then 'open' "
    "when o_orderstatus = 'P' then 'in_progress' else 'completed' end as status",
]

EMPLOYEE_COLUMNS = [
    "cast(s_suppkey + 1 as int) as id",
    "concat('First', cast(s_suppkey as STRING)) as first_name",
    "concat('Last', cast(s_suppkey % 5 as STRING)) as last_name",
    "concat('first', cast(s_suppkey as STRING), '@example.com') as email",
    "case s_suppkey % 5 when 0 then 'Maintenance' when 1 then 'Quality Control' when 2 then 'Operations' "
    "when 3 then 'Engineering' else null end as department",
    "s_suppkey % 10 <> 9 as active",
]


# The feed as row changes: arrival order and time come with each row.
CHANGE_COLUMNS = FEED_COLUMNS + ["event_id as seq", "ts as changed_at"]

# The time of a reading inside an envelope.
TIME_FIELD = '"datetime":"[^"]*"'

# Work-order requests with missing, empty, null, falsy and overlong fields, over the work_orders view.
# Every nineteenth comes twice.
_K = "cast(substr(id, 4) as bigint)"
REQUEST_COLUMNS = [
    f"{_K} as request_key",
    f"""case when {_K} % 37 = 0 then concat('{{"machine_id":"', machine_id) else concat('{{', concat_ws(',',
        case when {_K} % 11 = 0 then null when {_K} % 13 = 0 then '"machine_id":""' when {_K} % 43 = 0 then '"machine_id":0'
             when {_K} % 47 = 0 then '"machine_id":false' else concat('"machine_id":"', machine_id, '"') end,
        case when {_K} % 17 = 0 then '"issue_description":null' when {_K} % 53 = 0 then '"issue_description":[]'
             else concat('"issue_description":"', issue_description, '"') end,
        case when {_K} % 5 = 0 then null when {_K} % 29 = 0 then '"priority":null'
             when {_K} % 31 = 0 then '"priority":"urgent"' else concat('"priority":"', priority, '"') end,
        case when {_K} % 23 = 0 then '"reporter_name":""' when {_K} % 59 = 0 then '"reporter_name":{{}}'
             when {_K} % 41 = 0 then concat('"reporter_name":"', repeat('x', 101), '"')
             else concat('"reporter_name":"', reporter_name, '"') end,
        case when assignee is null then null when {_K} % 61 = 0 then '"assignee":0.0'
             else concat('"assignee":"', assignee, '"') end), '}}') end as raw""",
]

# Work orders that break the table's constraints, over the work_orders view.
CANDIDATE_COLUMNS = [
    f"concat('WO-', cast({_K} - {_K} % 3 % 2 as STRING)) as id",
    f"case when {_K} % 11 = 0 then null else machine_id end as machine_id",
    "issue_description",
    f"case when {_K} % 31 = 0 then 'urgent' else priority end as priority",
    f"case when {_K} % 41 = 0 then repeat('x', 101) else reporter_name end as reporter_name",
    "assignee", "timestamp", "created_at",
    f"case when {_K} % 43 = 0 then 'paused' else status end as status",
]


def _paren_end(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return i
    raise ValueError(text)


def for_spark(expression: str) -> str:
    while "MINS(" in expression:
        at = expression.index("MINS(")
        end = _paren_end(expression, at + 4)
        expression = (f"{expression[:at]}make_dt_interval(0, 0, cast({expression[at + 5:end]} as int))"
                      f"{expression[end + 1:]}")
    return expression.replace("TS'", "timestamp_ntz'")


def for_duckdb(expression: str) -> str:
    return (expression.replace("MINS(", "to_minutes(").replace("TS'", "timestamp '")
            .replace("as STRING", "as varchar").replace("as timestamp", 'as "timestamp"'))


def _view(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*map(for_spark, columns))


def machine_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", FEED_COLUMNS)


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", ORDER_COLUMNS)


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", EMPLOYEE_COLUMNS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", CHANGE_COLUMNS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = work_orders(spark, sf_dir).selectExpr(*map(for_spark, REQUEST_COLUMNS))
    return once.unionByName(once.filter(REPEATED))


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_orders(spark, sf_dir).selectExpr(*map(for_spark, CANDIDATE_COLUMNS))


REPEATED = "request_key % 19 = 0"


def row_text(schema, duckdb: bool = False) -> str:
    """A row as one text that both engines write alike: whole numbers, hundredths, microseconds, days."""
    text = "varchar" if duckdb else "string"
    kinds = {
        "double": f"cast(cast(round({{c}} * 100.0) as bigint) as {text})",
        "timestamp_ntz": f"cast({'epoch_us({c})' if duckdb else 'unix_micros(cast({c} as timestamp))'} as {text})",
    }
    parts = [f"coalesce({kinds.get(f.dataType.simpleString(), f'cast({{c}} as {text})').format(c=f.name)}, '-')" for f in schema]
    return f"concat_ws('|', {', '.join(parts)})"


def _cte(name: str, table: str, columns: list[str]) -> str:
    return f"{name} as (select {', '.join(map(for_duckdb, columns))} from {table})"


FEED_CTE = _cte("machine_feed", "events", FEED_COLUMNS)
ORDERS_CTE = _cte("work_orders", "orders", ORDER_COLUMNS)
EMPLOYEES_CTE = _cte("employees", "supplier", EMPLOYEE_COLUMNS)
CHANGES_CTE = _cte("changes", "events", CHANGE_COLUMNS)
CANDIDATES_CTE = _cte("candidates", "work_orders", CANDIDATE_COLUMNS)
REQUESTS_CTE = (f"{_cte('requested', 'work_orders', REQUEST_COLUMNS)}, "
                f"requests as (from requested union all from requested where {REPEATED})")
