"""Streams whose memory is the engine's own state store, by buckets of machines.

The state lies in the streaming checkpoint, versioned by batch: a restart or a lost
executor goes on from the last committed one, and nothing is stored beside it.  Outputs
go through ``append_batch`` like those of the other jobs, so a replayed batch replaces
its own rows.  A call of Python and its state serve all machines of one of ``BUCKETS`` buckets:
a call costs some milliseconds however few rows it gets, and a machine has few rows a trigger.
A bucket's rows of one trigger are put in order by one task; the source's admission limit
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds them.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millwatch import schemas
from millwatch.functions.times import micros
from millwatch.operators.changes import NO_KEY, envelopes_of, image

#: Calls a trigger at most; a checkpoint belongs to the number it began with.
BUCKETS = 1024
_ORDERED = "machine_id int, machine_name string, type string, status string, at bigint, prev_status string, prev_at bigint"


def _key() -> Column:
    return F.coalesce("machine_name", F.lit(NO_KEY)).alias("key")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


# -- images before a change -----------------------------------------------------------------------


def _with_before(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["seq", "image"], ignore_index=True)
    before, last = [], json.loads(state.get[0]) if state.exists else {}
    for machine, now, deleted in zip(rows["key"], rows["image"], rows["deleted"]):
        before.append(last.pop(machine, None))
        if not deleted:
            last[machine] = now
    if last:
        state.update((json.dumps(last),))
    elif state.exists:
        state.remove()
    yield rows.drop(columns="bucket").assign(before=pd.Series(before, dtype=object))


def envelopes_of_stream(changes: DataFrame) -> DataFrame:
    """Row changes as ``seq`` and change envelopes; the image before comes from the machine's state.

    ``changes`` has ``seq``, ``changed_at``, the machine row and optionally ``deleted``.
    """
    if "deleted" not in changes.columns:
        changes = changes.withColumn("deleted", F.lit(False))
    rows = changes.select(
        _key(), "seq", "machine_name", micros(F.col("changed_at")).alias("at"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.to_json(image(F.col), {"ignoreNullFields": "false"}).alias("image"))
    kept = "key string, seq bigint, machine_name string, at bigint, deleted boolean, image string"
    seen = rows.withColumn("bucket", _bucket()).groupBy("bucket").applyInPandasWithState(
        _with_before, f"{kept}, before string", "images string", "append", GroupStateTimeout.NoTimeout)
    parsed = seen.select("seq", "machine_name", "at", "deleted", F.from_json("image", schemas.IMAGE).alias("image"),
                         F.from_json("before", schemas.IMAGE).alias("before"))
    return envelopes_of(parsed, F.col("at"), F.col("deleted"), F.col("before").isNotNull(), F.col("image"), F.col("before"))


# -- readings in order ----------------------------------------------------------------------------


def _in_order(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Readings up to the watermark, in order by machine, each with the one before it; later ones wait in the state."""
    last, waiting = (json.loads(state.get[0]), json.loads(state.get[1])) if state.exists else ({}, [])
    for frame in frames:
        ids = [None if gone else int(machine) for machine, gone in zip(frame["machine_id"], frame["machine_id"].isna())]
        waiting += map(list, zip(frame["key"], frame["at"].tolist(), ids, frame["status"], frame["machine_name"], frame["type"]))
    until = state.getCurrentWatermarkMs() * 1000
    blank_first = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    ready = sorted((r for r in waiting if r[1] <= until), key=blank_first)
    waiting = [r for r in waiting if r[1] > until]
    out = []
    for one, at, machine, status, name, kind in ready:
        out.append((machine, name, kind, status, at, *last.get(one, (None, None))))
        last[one] = [status, at]
    state.update((json.dumps(last), json.dumps(waiting)))
    if waiting:
        state.setTimeoutTimestamp(min(r[1] for r in waiting) // 1000 + 1)
    columns = [c.split()[0] for c in _ORDERED.split(", ")]
    yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(columns)})


def readings_in_order(readings: DataFrame, delay: str) -> DataFrame:
    """Each dated reading with ``prev_status`` and ``prev_datetime``, as soon as nothing earlier can come any more.

    ``delay`` is how late a reading may come; those that are later are dropped and counted in the
    query's progress (``numRowsDroppedByWatermark``).
    """
    rows = readings.filter(F.col("datetime").isNotNull()).select(
        _key(), "machine_id", "machine_name", "type", "status", micros(F.col("datetime")).alias("at"),
        F.col("datetime").cast("timestamp").alias("event")).withWatermark("event", delay)
    ordered = rows.withColumn("bucket", _bucket()).groupBy("bucket").applyInPandasWithState(
        _in_order, _ORDERED, "last string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return ordered.select("machine_id", "machine_name", "type", "status", time("at").alias("datetime"), "prev_status",
                          time("prev_at").alias("prev_datetime"))


# -- counts by hour -------------------------------------------------------------------------------


def hourly_counts_of_stream(readings: DataFrame, delay: str) -> DataFrame:
    """Readings by hour and status, once an hour is closed; plain streaming aggregation, reduced on the map side."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    dated = readings.withColumn("event", F.col("datetime").cast("timestamp")).withWatermark("event", delay)
    return dated.groupBy(F.window("event", "1 hour").alias("hour")).agg(
        status("operational"), status("down"), status("warning"), F.count(F.lit(1)).alias("total_readings")
    ).select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), "operational_count", "down_count", "warning_count", "total_readings")


def late_readings(history: DataFrame, hours: DataFrame) -> DataFrame:
    """Closed hours with how many readings came too late to be counted: what the history has beyond the counts."""
    held = history.filter(F.col("datetime").isNotNull()).groupBy(F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("at")).agg(
        F.count(F.lit(1)).alias("held"))
    return hours.join(held, F.col("hour") == F.col("at")).select(
        *hours.columns, (F.col("held") - F.col("total_readings")).alias("late_readings"))
