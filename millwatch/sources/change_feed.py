"""The change feed as a stream of JSON texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_change_stream(
    spark: SparkSession, path: str | None = None, source: str = "text", **options: str,
) -> DataFrame:
    """A stream with one column, ``value``.

    ``path`` reads a folder that receives text files; ``source="kafka"`` with the
    usual options reads a topic instead.
    """
    reader = spark.readStream.format(source).options(**options)
    if source == "text":
        return reader.schema("value string").load(path)
    stream = reader.load(path) if path else reader.load()
    return stream.select(F.col("value").cast("string").alias("value"))
