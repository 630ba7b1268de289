"""Work-order requests: validation, defaults and ids."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch import schemas
from millwatch.functions.times import at
from millwatch.operators.neighbours import COPY_BLOCK

REQUIRED = ["machine_id", "issue_description", "reporter_name"]


# The JSON values that count as missing: null, false, zero, and empty texts, lists and objects.
_FALSY = r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE][-+]?[0-9]+)?)$'
_FIELDS = schemas.REQUEST.fieldNames()


def work_order_id(key: Column, as_of: datetime) -> Column:
    """``WO-YYYYMMDD-`` and 32 hex digits; the same key gives the same id, so reruns do not duplicate orders."""
    return F.concat(F.lit(as_of.strftime("WO-%Y%m%d-")), F.substring(F.sha2(key.cast("string"), 256), 1, 32))


def _first_error(row: dict[str, Column]) -> Column:
    error = F.when(~F.col("is_object"), "request is not a JSON object").when(F.col("request_key").isNull(), "request has no key")
    for name in REQUIRED:
        error = error.when(row[name].isNull(), f"{name} is required")
    error = error.when(~row["priority"].isin(*fv.PRIORITIES), "priority is not allowed")
    for name, length in fv.MAX_LENGTHS["work_orders"].items():
        if name in row:
            error = error.when(F.length(row[name]) > length, f"{name} is longer than {length}")
    return error


def _parsed(requests: DataFrame) -> DataFrame:
    """Each request once, with its copies counted; per field ``<f>`` (NULL if falsy) and ``<f>_json``.

    The generator parses a request once; fields of a plain ``from_json`` column
    would be parsed again by every condition pushed below it.
    """
    kinds = ", ".join(f"{f} variant" for f in _FIELDS)
    once = requests.groupBy("request_key", "raw").agg(F.count(F.lit(1)).alias("_n"))
    rows = once.select("request_key", "raw", "_n", F.json_object_keys("raw").isNotNull().alias("is_object"),
                       F.inline(F.array(F.from_json("raw", kinds))))
    json = rows.select("request_key", "raw", "_n", "is_object", *_FIELDS,
                       *[F.to_json(F.col(f)).alias(f"{f}_json") for f in _FIELDS])
    given = lambda f: F.when(~F.col(f"{f}_json").rlike(_FALSY), F.expr(f"cast({f} as string)"))
    return json.select("request_key", "raw", "_n", "is_object", *[given(f).alias(f) for f in _FIELDS],
                       *[f"{f}_json" for f in _FIELDS], F.expr("cast(priority as string)").alias("priority_text"))


def ingest_work_orders(requests: DataFrame, as_of: datetime, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split requests into ``(accepted, rejected)``.

    ``requests`` holds ``request_key`` and ``raw`` JSON text.  Accepted rows are
    work orders; rejected rows keep the request and name its first error.  Only
    an absent priority takes the default; an explicit null does not.  An id that
    ``existing`` (id) holds is rejected, and so is every request but the first, by its
    text, of those that share a key.
    """
    row = {
        "machine_id": F.col("machine_id"),
        "issue_description": F.col("issue_description"),
        "priority": F.when(F.col("priority_json").isNull(), fv.DEFAULT_PRIORITY)
                     .when(F.col("priority_json") == "null", "None").otherwise(F.col("priority_text")),
        "reporter_name": F.col("reporter_name"),
        "assignee": F.coalesce("assignee", F.lit("")),
    }
    checked = _parsed(requests).select(
        "request_key", "raw", "_n", _first_error(row).alias("error"), work_order_id(F.col("request_key"), as_of).alias("id"),
        *[column.alias(name) for name, column in row.items()])
    good, bad = checked.filter("error is null"), checked.filter("error is not null")
    # Which text of an id is the first is an aggregate, so an id with very many texts is no task of its own.
    first = good.groupBy(F.col("id").alias("_id")).agg(F.min("raw").alias("_first"))
    # Both sides hold a row per request.  The planner takes the parsed rows for a few bytes (a generator counts for
    # nothing in its estimate) and would broadcast them, which adaptive execution does not take back.
    good = good.join(first.hint("merge"), F.col("id") == F.col("_id"))
    if existing is not None:
        known = existing.select(F.col("id").alias("_known")).distinct()
        good = good.join(known.hint("merge"), F.col("id") == F.col("_known"), "left")
    else:
        good = good.withColumn("_known", F.lit(None).cast("string"))
    # Not ``==``, which would become a join key: ids alone deal both sides out as ``first`` already is.
    new = F.col("_known").isNull() & (F.col("raw") <= F.col("_first"))
    now = at(as_of)
    accepted = good.filter(new).select(
        "id", *row, now.alias("timestamp"), now.alias("created_at"), F.lit(fv.DEFAULT_ORDER_STATUS).alias("status"))
    again = good.select("request_key", "raw", F.lit("id already exists").alias("error"),
                        (F.col("_n") - new.cast("int")).alias("_n")).filter("_n > 0")
    rejected = bad.select("request_key", "raw", "error", "_n").unionByName(again)
    return accepted, written_out(rejected, "_n")


def written_out(rows: DataFrame, count: str) -> DataFrame:
    """Each row as often as ``count`` says, dealt out in blocks, so that a million copies are no single task's."""
    kept = [c for c in rows.columns if c != count]
    blocks = rows.select(*kept, count, F.explode(F.expr(f"sequence(0L, ({count} - 1) div {COPY_BLOCK})")).alias("_block"))
    size = F.expr(f"int(least({COPY_BLOCK}L, {count} - _block * {COPY_BLOCK}))")
    # A block's bytes say nothing of what it becomes: a fixed number of parts, which adaptive execution does not merge.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "_block", *kept).select(*kept, F.explode(F.array_repeat(F.lit(1), size)).alias("_copy")).drop("_copy")


def with_defaults(rows: DataFrame, as_of: datetime, **defaults: object) -> DataFrame:
    """Fill missing columns and NULLs: ``created_at`` with the time, others with the given values."""
    values = {"created_at": at(as_of), **{name: F.lit(value) for name, value in defaults.items()}}
    for name, value in values.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows
