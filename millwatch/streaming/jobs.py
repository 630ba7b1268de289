"""Streaming jobs.

Every job is one query with ``foreachBatch``.  Each sink replaces the output of
its own batch, so a replay after a lost executor or driver leaves the tables as
one run would.  What a job remembers is in the engine's state store, part of its
checkpoint, and a batch writes no more than its own changes.  Jobs on one feed may run
side by side on one ``root``: each has a checkpoint of its own there.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch import schemas
from millwatch.functions.machines import display_status
from millwatch.operators.changes import dead_letter, envelope_json, parse_envelopes, readings_of
from millwatch.operators.ingest import ingest_work_orders, work_order_id
from millwatch.operators.latest import folded_variants, latest_of_variants, newest_variants
from millwatch.plans.floor import live_floor
from millwatch.sources import changelog, key_index
from millwatch.sources.tables import DEAD, append_batch, append_history, append_variants, append_work_orders
from millwatch.streaming import stateful

# The state's changelog is folded every so many batches.
FOLD_EVERY = 100
# Every trigger leaves a folder per table and day until it is compacted.
TRIGGER = "1 minute"


def _start(stream: DataFrame, root: str, handle, once: bool, every: str = TRIGGER, mode: str = "append",
           checkpoint: str = "checkpoint") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/{checkpoint}").foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def follow_changes(messages: DataFrame, root: str, once: bool = False) -> StreamingQuery:
    """Fan the change feed out: message log with its dead letters, history with its summaries by day, and down alerts.

    ``messages`` has the envelope text in ``value``.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = parse_envelopes(batch).persist()
        try:
            log = batch.select("value", F.current_timestamp().alias("received_at"), dead_letter().alias(DEAD))
            append_batch(log, f"{root}/messages", batch_id, DEAD)
            readings = readings_of(batch)
            append_history(readings, f"{root}/history", batch_id)
            append_variants(readings, f"{root}/variants", batch_id)
            alerts = readings.filter(display_status(F.col("status")) == "down")
            append_batch(alerts, f"{root}/down_alerts", batch_id)
        finally:
            batch.unpersist()

    return _start(messages, root, handle, once)


def follow_state(messages: DataFrame, root: str, once: bool = False, initial: DataFrame | None = None) -> StreamingQuery:
    """Keep the newest reading of each variant of a machine: a streaming aggregate in update mode.

    The engine's state holds the variants; a batch puts out those that its readings have changed, and only
    these are written.  ``initial``, readings known before the stream starts, are added with the first batch.
    """
    def handle(changed: DataFrame, batch_id: int) -> None:
        if initial is not None and batch_id == 0:
            changed = changed.unionByName(newest_variants(initial))
        changelog.add(changed.select(*schemas.VARIANTS.fieldNames()), f"{root}/state", batch_id)
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            changelog.fold(changed.sparkSession, f"{root}/state", schemas.VARIANTS, folded_variants)

    return _start(newest_variants(readings_of(parse_envelopes(messages))), root, handle, once, mode="update", checkpoint="state_checkpoint")


def current_variants(spark: SparkSession, root: str) -> DataFrame:
    """The streamed state: the newest reading of each variant of a machine."""
    return folded_variants(changelog.read(spark, f"{root}/state", schemas.VARIANTS))


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest reading of each machine; one without a time comes after all others."""
    return latest_of_variants(current_variants(spark, root), undated_first=False)


def current_floor(spark: SparkSession, root: str, floor: DataFrame) -> DataFrame:
    """The live floor as the initial readings and the stream so far show it."""
    return live_floor(floor, current_snapshot(spark, root))


def publish_changes(changes: DataFrame, root: str, once: bool = False) -> StreamingQuery:
    """Turn a stream of row changes into change envelopes, as JSON text below ``root/envelopes``.

    ``changes`` has ``seq``, ``changed_at``, the machine row and optionally ``deleted``.  The image
    before a change comes from the engine's state: the machine's last row by arrival.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, f"{root}/envelopes", batch_id)

    return _start(envelope_json(stateful.envelopes_of_stream(changes)).select("seq", "value"), root, handle, once)


def follow_transitions(messages: DataFrame, root: str, delay: str, once: bool = False) -> StreamingQuery:
    """Readings with the status before them below ``root/transitions``, in order of time however they arrive within ``delay``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, f"{root}/transitions", batch_id)

    stream = stateful.readings_in_order(readings_of(parse_envelopes(messages)), delay)
    return _start(stream, root, handle, once, checkpoint="transitions_checkpoint")


def follow_hours(messages: DataFrame, root: str, delay: str, once: bool = False) -> StreamingQuery:
    """Counts of closed hours below ``root/hours``; readings later than ``delay`` are not in them."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, f"{root}/hours", batch_id)

    stream = stateful.hourly_counts_of_stream(readings_of(parse_envelopes(messages)), delay)
    return _start(stream, root, handle, once, checkpoint="hours_checkpoint")


def follow_requests(requests: DataFrame, root: str, as_of: datetime | None = None, once: bool = False) -> StreamingQuery:
    """Validate a stream of work-order requests and append the accepted ones to ``root/work_orders``.

    ``requests`` has ``request_key`` and ``raw``; rejected requests go to ``root/rejected``, also
    those whose id any earlier batch has stored: the ids are looked up in their index, no order is read.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        now, index = as_of or datetime.now(timezone.utc).replace(tzinfo=None), f"{root}/order_ids"
        batch = batch.persist()
        try:
            ids = batch.select(work_order_id(F.col("request_key"), now).alias("key")).distinct().filter("key is not null")
            accepted, rejected = ingest_work_orders(batch, now, key_index.held(ids, index, batch_id).select(F.col("key").alias("id")))
            append_work_orders(accepted, f"{root}/work_orders", batch_id)
            append_batch(rejected, f"{root}/rejected", batch_id)
            key_index.add(key_index.counted(accepted, "id"), index, batch_id)
        finally:
            batch.unpersist()

    return _start(requests, root, handle, once)
