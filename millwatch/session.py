"""Session defaults and the shared scratch folder."""

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The scratch folders given out, with the thread that asked.
_GIVEN: list[tuple[int, str]] = []
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "millwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on: UTC, ANSI and AQE."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{name.replace("__", "."): value for name, value in conf.items()},
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that the driver and all executors share.

    It lies below ``spark.checkpoint.dir``, or below the warehouse folder where that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _GIVEN.append((threading.get_ident(), path))
    return path


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the scratch folders that this thread was given inside: for work whose results are written by then."""
    before = set(_GIVEN)
    try:
        yield
    finally:
        for given in [g for g in _GIVEN if g not in before and g[0] == threading.get_ident()]:
            _GIVEN.remove(given)
            drop_scratch(spark, given[1])


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch folders given out so far; no table that reads them may be used again."""
    while _GIVEN:
        drop_scratch(spark, _GIVEN.pop()[1])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared scratch folder and read back: lineage ends here.

    Shuffle files of the write go with it; nothing will read them again.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, purpose)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str) -> tuple:
    """A folder and its file system, whichever it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder that no reader needs any more."""
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder, system = _folder(spark, path)
    return system.exists(folder)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it does not exist."""
    folder, system = _folder(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(folder) if f.isDirectory()) if system.exists(folder) else []
