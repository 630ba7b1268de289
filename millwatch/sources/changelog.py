"""A keyed table of rows that fold, as a stream leaves it.

A batch adds only its changed rows, in a folder of its own; readers fold what they find.
``fold`` writes the folded rows of all batches so far once more, and readers then start
from there; ``clean`` removes what came before the newest fold, when no reader can still
use it.  A replayed batch replaces its own folder, and one that a fold already holds is
left aside, so neither changes a reader's rows.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millwatch.session import drop_scratch, exists, subfolders


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    names = [n for n in subfolders(spark, path) if n.startswith(f"{kind}=")]
    return sorted(int(n.removeprefix(f"{kind}=")) for n in names if exists(spark, f"{path}/{n}/_SUCCESS"))


def add(rows: DataFrame, path: str, batch_id: int) -> None:
    """The rows that a batch has changed."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that are to be folded: the newest fold's and those of later batches."""
    folded = max(_complete(spark, path, "fold"), default=-1)
    folders = [f"{path}/fold={folded}"] * (folded >= 0)
    folders += [f"{path}/batch={b}" for b in _complete(spark, path, "batch") if b > folded]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def fold(spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Write ``merge`` of all rows so far as one fold."""
    newest = max(_complete(spark, path, "batch"), default=None)
    if newest is not None:
        merge(read(spark, path, schema)).write.mode("overwrite").parquet(f"{path}/fold={newest}")


def clean(spark: SparkSession, path: str) -> None:
    folds = _complete(spark, path, "fold")
    for kind, numbers in (("fold", folds[:-1]), ("batch", [b for b in _complete(spark, path, "batch") if folds and b <= folds[-1]])):
        for n in numbers:
            drop_scratch(spark, f"{path}/{kind}={n}")
