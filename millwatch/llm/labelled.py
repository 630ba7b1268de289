"""What the two classifiers share: folds, the bounded training sample, scoring.

A classifier learns from at most ``sample`` labelled rows (the documented bound),
those with the smallest hash of the id; features and scores cover all documents
and whole texts.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the bytes and offsets of some texts to one row of features each.
Features = Callable[[np.ndarray, np.ndarray], np.ndarray]

SAMPLE = 20_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 <= fold; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
                  id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(text, label) of the sample: labelled, not held out; of several labels of an id the largest counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # the bound: at most ``sample`` rows
    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_label")


def features_of(rows: DataFrame, compute: Features, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training rows, on the driver (bounded by the sample)."""
    from millwatch.llm.packed import text_chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(batch.schema.get_field_index("_label"))
            for a, b, data, offsets in text_chunks(batch, "_text"):
                x = compute(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), label.slice(a, b - a)], ["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").toArrow()
    order = sorted(zip(got["x"].to_pylist(), got["y"].to_pylist()))  # the same model whatever order tasks end in
    x = np.array([r[0] for r in order], float).reshape(len(order), width)
    return x, np.array([r[1] for r in order], float)


def scored(docs: DataFrame, compute: Features, score: Callable[[np.ndarray], np.ndarray], id_col: str = "doc_id",
           text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the ``keep`` columns and the score of every row."""
    from millwatch.llm.packed import text_chunks

    columns = [id_col, *keep]
    rows = docs.select(*columns, *([] if text in columns else [text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch, text):
                out = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in columns]
                yield pa.RecordBatch.from_arrays([*out, pa.array(score(compute(data, offsets)), pa.float64())], [*columns, "score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, score double")
