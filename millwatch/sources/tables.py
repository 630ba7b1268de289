"""Base, history and gold tables as Parquet folders."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch import schemas
from millwatch.operators.latest import folded_variants, newest_variants
from millwatch.session import drop_scratch, exists, subfolders


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``; partition columns of the folder stay out of the result."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FEED)


def read_work_orders(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.WORK_ORDERS)


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.EMPLOYEES)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The append-only feed history, partitioned by day; look-backs prune its partitions."""
    return _read_days(spark, path, schemas.HISTORY, "event_date")


def read_stored_work_orders(spark: SparkSession, path: str) -> DataFrame:
    """The work orders that streamed in, partitioned by day of creation."""
    return _read_days(spark, path, schemas.STORED_WORK_ORDERS, "created_date")


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """The messages of the log that could not be read."""
    return spark.read.schema(f"value string, {DEAD} boolean").parquet(path).filter(DEAD).select("value")


# -- compaction -----------------------------------------------------------------------------------
#
# A stream leaves a folder per day and batch.  ``compact`` rewrites what batches up to some
# number hold of the days before some day into sound files below ``_closed`` and then writes
# the two limits.  Readers take ``_closed`` and, of the folders of the batches, what lies
# outside the limits; rows that come late for a closed day are outside, until the next run.

# Marks unreadable messages in the log, which is partitioned by it.
DEAD = "dead"


def _limits(spark: SparkSession, path: str) -> tuple[int, object, int] | None:
    """(run, first open day, last closed batch) of the newest complete run."""
    runs = [n for n in subfolders(spark, f"{path}/_closed_until") if exists(spark, f"{path}/_closed_until/{n}/_SUCCESS")]
    if not runs:
        return None
    run = max(int(n.removeprefix("run=")) for n in runs)
    row = spark.read.schema("day date, batch bigint").parquet(f"{path}/_closed_until/run={run}").first()
    return run, row["day"], row["batch"]


def _read_days(spark: SparkSession, path: str, schema: T.StructType, day: str) -> DataFrame:
    rows, limits = spark.read.schema(schema).parquet(path), _limits(spark, path)
    if limits is None:
        return rows
    run, first_open, batch = limits
    names = [f"{path}/_closed/run={r}" for r in range(run + 1)]
    names = [n for n in names if exists(spark, n)]
    rows = rows.filter((F.col(day) >= F.lit(first_open)) | F.col(day).isNull() | (F.col("batch_id") > batch))
    for name in names:
        rows = rows.unionByName(spark.read.schema(schema).parquet(name).select(*rows.columns))
    return rows


def compact(spark: SparkSession, path: str, schema: T.StructType, day: str, first_open: date, batch: int) -> None:
    """Close the days before ``first_open`` for batches up to ``batch``; their folders are then removed.

    A run that fails leaves the table as it was.  Remove the old folders (``clean``) only
    when no reader can still use them.
    """
    limits = _limits(spark, path)
    run = limits[0] + 1 if limits else 0
    rows = spark.read.schema(schema).parquet(path).filter((F.col(day) < F.lit(first_open)) & (F.col("batch_id") <= batch))
    if limits:
        rows = rows.filter((F.col(day) >= F.lit(limits[1])) | (F.col("batch_id") > limits[2]))
        first_open, batch = max(first_open, limits[1]), max(batch, limits[2])
    # the batch stays known, as a column, so that compacted rows look like all others
    rows.hint("rebalance", day).write.mode("overwrite").partitionBy(day).parquet(f"{path}/_closed/run={run}")
    row = spark.createDataFrame([(first_open, batch)], "day date, batch bigint")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/_closed_until/run={run}")


def clean(spark: SparkSession, path: str, day: str) -> None:
    """Remove the batch folders whose rows are closed."""
    limits = _limits(spark, path)
    for folder in subfolders(spark, path) if limits else []:
        value = folder.removeprefix(f"{day}=")
        if value != folder and not value.startswith("__") and date.fromisoformat(value) < limits[1]:
            for batch in subfolders(spark, f"{path}/{folder}"):
                if int(batch.removeprefix("batch_id=")) <= limits[2]:
                    drop_scratch(spark, f"{path}/{folder}/{batch}")


def append_history(readings: DataFrame, path: str, batch_id: int) -> None:
    """Add one batch of readings."""
    rows = readings.select(*schemas.FEED.fieldNames()).withColumn("event_date", F.to_date("datetime"))
    _append_days(rows, path, "event_date", batch_id)


def append_variants(readings: DataFrame, path: str, batch_id: int) -> None:
    """Add what one batch of readings shows of each variant of a machine, by day: a few rows a machine, however many readings."""
    rows = readings.withColumn("event_date", F.to_date("datetime"))
    _append_days(newest_variants(rows, by=["event_date"]), path, "event_date", batch_id)


def read_variants(spark: SparkSession, path: str, until: date | None = None) -> DataFrame:
    """The variants of the whole history, or of its days up to ``until`` and its undated readings, from the summaries alone.

    Late readings are in the summary of their own batch and day, so they fold in like all others.
    """
    rows = spark.read.schema(schemas.DAY_VARIANTS).parquet(path)
    if until is not None:
        rows = rows.filter((F.col("event_date") <= F.lit(until)) | F.col("event_date").isNull())
    return folded_variants(rows)


def append_work_orders(orders: DataFrame, path: str, batch_id: int) -> None:
    """Add one batch of work orders."""
    rows = orders.select(*schemas.WORK_ORDERS.fieldNames()).withColumn("created_date", F.to_date("created_at"))
    _append_days(rows, path, "created_date", batch_id)


def _append_days(rows: DataFrame, path: str, day: str, batch_id: int) -> None:
    """A batch owns its ``batch_id`` folder of each day and replaces only that, so a
    replayed batch leaves the table as it was.  The rebalance hint lets adaptive
    execution split a busy day and merge thin ones into sound files.
    """
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .hint("rebalance", day)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day, "batch_id").parquet(path)
    )


def append_batch(rows: DataFrame, path: str, batch_id: int, *by: str) -> None:
    """Add one batch to a table partitioned by batch, and ``by`` below it; a replay replaces the batch."""
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *by).parquet(path)
    )


def squeeze_spaces(rows: DataFrame, column: str) -> DataFrame:
    """Opt-in repair: runs of blanks and line breaks inside a text become one blank."""
    return rows.withColumn(column, F.trim(F.regexp_replace(column, r"\s+", " ")))


def empty_as_null(rows: DataFrame, column: str) -> DataFrame:
    """Opt-in repair: an empty text counts as missing."""
    return rows.withColumn(column, F.nullif(F.col(column), F.lit("")))
