"""The history clustered by machine and time, so that lag and lead need no shuffle.

A run sorts whole days into ranges of (day, machine, time), of like size whatever a
machine sends, and writes them to a table bucketed by the number of the range.  A
window inside (range, machine) then works where the files are read, and a hot machine
still spreads over as many ranges as it fills.  Along a machine the numbers ascend with
time, which is all that closing the gaps between ranges needs.  Days are partitions, so
a look-back reads its own days only.

Equal readings are one row with their number in ``copies``.  A run adds days after all
days of the table; a reading that comes later for one of them goes into the table when it is
built anew.  The table lies in the session's catalog; ``path`` places its files.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import schemas
from millwatch.functions.times import since
from millwatch.operators.ranges import RANGE

#: The order along a machine, and what tells its rows apart.
ALONG = ["datetime", "machine_id", "status", "type"]
BUCKETS = 64


def add_days(readings: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS) -> None:
    """Add the readings of days that the table does not have yet; the first run makes the table."""
    spark = readings.sparkSession
    there = spark.catalog.tableExists(table)
    rows = readings.select(*schemas.FEED.fieldNames()).groupBy(*schemas.FEED.fieldNames()).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("event_date", F.to_date("datetime"))
    first = 0
    if there:
        last = spark.table(table).agg(F.max("event_date").alias("day"), F.max("part").alias("part")).first()
        if last["day"] is not None and rows.filter(F.col("event_date") <= F.lit(last["day"])).limit(1).count():
            raise ValueError(f"{table} has {last['day']} and earlier days already")
        first = 0 if last["part"] is None else last["part"] + 1
    # As many ranges as buckets; a bucket holds what its hash gives it of each run.
    placed = rows.repartitionByRange(buckets, "event_date", "machine_name", *ALONG).withColumn(
        "part", F.spark_partition_id() + F.lit(first))
    writer = placed.write.mode("append").format("parquet").partitionBy("event_date").bucketBy(buckets, "part").sortBy("machine_name", "datetime")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_placed(spark: SparkSession, table: str, as_of: datetime, days: int) -> DataFrame:
    """Dated readings of the look-back with their copies and range."""
    return since(spark.table(table), "datetime", as_of, days).select(
        *schemas.FEED.fieldNames(), F.col("copies").alias("_copies"), F.col("part").alias(RANGE))


def read_readings(spark: SparkSession, table: str) -> DataFrame:
    """All readings, equal ones once with their ``copies``."""
    return spark.table(table).select(*schemas.FEED.fieldNames(), "copies")
