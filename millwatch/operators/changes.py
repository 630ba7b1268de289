"""Change envelopes: building, diffing, parsing and folding them."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch import schemas
from millwatch.functions.times import iso_text, micros
from millwatch.operators.latest import latest_of_variants, latest_readings, newest_variants
from millwatch.operators.neighbours import with_neighbours

_FIELDS = ["machine_id", "machine_name", "status", "type", "datetime"]


def image(field) -> Column:
    """A machine row as it stands in an envelope."""
    return F.struct(
        field("machine_id").alias("machine_id"), field("machine_name").alias("machine_name"),
        field("status").alias("status"), field("type").alias("type"),
        iso_text(field("datetime")).alias("datetime"),
    )


# A NULL key is a group of its own; stored text cannot contain this character.
NO_KEY = "\u0000"


def change_envelopes(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One envelope per row change, with the images before and after.

    ``changes`` holds ``seq`` (arrival order), ``changed_at``, the machine row and
    optionally ``deleted``.  The first change of a machine is an INSERT unless
    ``known`` holds its row already.  Every update counts, changed or not.
    """
    if "deleted" not in changes.columns:
        changes = changes.withColumn("deleted", F.lit(False))
    seen = with_neighbours(
        changes, "machine_name", ["seq"], before=["seq", "deleted", *[f for f in _FIELDS if f != "machine_name"]])
    inside = F.col("prev_seq").isNotNull() & ~F.col("prev_deleted")
    if known is None:
        before = {f: F.when(inside, F.col(f"prev_{f}")) for f in _FIELDS if f != "machine_name"}
        exists = inside
    else:
        # only the first change of a machine looks its row up; the others get a key of
        # their own that matches nothing, so a busy machine stays spread over the tasks
        link = F.when(F.col("prev_seq").isNull(), F.coalesce("machine_name", F.lit(NO_KEY))) \
            .otherwise(F.concat(F.lit(NO_KEY), F.col("seq").cast("string")))
        stored = known.select(F.coalesce("machine_name", F.lit(NO_KEY)).alias("_known"),
                              *[F.col(f).alias(f"_known_{f}") for f in _FIELDS if f != "machine_name"])
        seen = seen.withColumn("_link", link)
        seen = seen.join(stored, seen["_link"] == stored["_known"], "left")
        before = {
            f: F.when(inside, F.col(f"prev_{f}")).when(F.col("prev_seq").isNull(), F.col(f"_known_{f}"))
            for f in _FIELDS if f != "machine_name"
        }
        exists = inside | F.col("_known").isNotNull()

    old = F.when(exists, image(lambda f: F.col("machine_name") if f == "machine_name" else before[f]))
    return envelopes_of(seen, micros(F.col("changed_at")), F.col("deleted"), exists, image(F.col), old)


def envelopes_of(rows: DataFrame, at: Column, deleted: Column, exists: Column, new: Column, old: Column) -> DataFrame:
    """``seq``, ``machine_name`` and the envelope columns of row changes; ``at`` in microseconds."""
    operation = F.when(deleted, "DELETE").when(exists, "UPDATE").otherwise("INSERT")
    return (
        rows.select("seq", "machine_name", operation.alias("operation"), exists.alias("_exists"),
                    (at.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)").alias("timestamp"),
                    F.when(~deleted, new).alias("new_data"), old.alias("old_data"))
        # deleting a row that is not there changes nothing
        .filter((F.col("operation") != "DELETE") | F.col("_exists"))
        .drop("_exists")
    )


def diff_snapshots(old: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """Envelopes that turn snapshot ``old`` into ``new``, matched by machine name."""
    left = old.select(*[F.col(f).alias(f"old_{f}") for f in _FIELDS])
    right = new.select(*[F.col(f).alias(f"new_{f}") for f in _FIELDS])
    both = left.join(right, F.col("old_machine_name") == F.col("new_machine_name"), "full_outer")
    gone, born = F.col("new_machine_name").isNull(), F.col("old_machine_name").isNull()
    same = F.lit(True)
    for f in _FIELDS:
        same = same & F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    seconds = as_of.timestamp() if as_of.tzinfo else (as_of - datetime(1970, 1, 1)).total_seconds()
    return both.filter(~same).select(
        F.coalesce("new_machine_name", "old_machine_name").alias("machine_name"),
        F.when(gone, "DELETE").when(born, "INSERT").otherwise("UPDATE").alias("operation"),
        F.lit(f"{seconds:.6f}").cast("decimal(20,6)").alias("timestamp"),
        F.when(~gone, image(lambda f: F.col(f"new_{f}"))).alias("new_data"),
        F.when(~born, image(lambda f: F.col(f"old_{f}"))).alias("old_data"),
    )


def envelope_json(envelopes: DataFrame, table: str = fv.FEED_TABLE) -> DataFrame:
    """The envelope as JSON text in ``value``.  An INSERT carries a null ``old_data``, a DELETE no ``new_data``."""
    head = [F.col("operation"), F.lit(table).alias("table"), F.col("timestamp")]
    keep_nulls = {"ignoreNullFields": "false"}
    text = F.when(F.col("operation") == "DELETE", F.to_json(F.struct(*head, F.col("old_data")), keep_nulls)) \
        .otherwise(F.to_json(F.struct(*head, F.col("new_data"), F.col("old_data")), keep_nulls))
    return envelopes.withColumn("value", text)


def parse_envelopes(messages: DataFrame) -> DataFrame:
    """``value`` and the envelope columns; all of them NULL where ``value`` is not an envelope.

    The generator parses each message once, however many conditions look at its fields.
    """
    return messages.select("value", F.inline(F.array(F.from_json("value", schemas.ENVELOPE))))


def _named() -> Column:
    return F.coalesce(F.col("new_data.machine_name"), F.lit("")) != ""


def _time() -> Column:
    """The reading's time, NULL for a text that is none."""
    return F.expr("try_cast(new_data.datetime as timestamp_ntz)")


def _untimed() -> Column:
    """A text stands where the time should be, but it is no time."""
    return F.col("new_data.datetime").isNotNull() & _time().isNull()


def readings_of(envelopes: DataFrame) -> DataFrame:
    """The machine rows of the envelopes that carry one; DELETEs, nameless rows and unreadable times do not."""
    return envelopes.filter(_named() & ~_untimed()).select(
        *[F.col(f"new_data.{f}").alias(f) for f in _FIELDS if f != "datetime"], _time().alias("datetime"))


def dead_letter() -> Column:
    """A message that cannot be read as an envelope, or a reading with an unreadable time."""
    return (F.col("operation").isNull() & ~_named()) | (_named() & _untimed())


def dead_letters(envelopes: DataFrame) -> DataFrame:
    return envelopes.filter(dead_letter()).select("value")


def fold_latest(snapshot: DataFrame, readings: DataFrame) -> DataFrame:
    """The snapshot after the readings; the newest event wins, whatever came last, and a reading without a time loses."""
    columns = schemas.FEED.fieldNames()
    rows = snapshot.select(*columns).unionByName(readings.select(*columns))
    return latest_of_variants(newest_variants(rows), undated_first=False)


def set_status(snapshot: DataFrame, updates: DataFrame) -> DataFrame:
    """Readings that set ``status`` and ``datetime`` of machines by name; unknown names change nothing.

    They go to the history; the snapshot follows by folding them.
    """
    rows = snapshot.select("machine_id", "machine_name", "type")
    return updates.select("machine_name", "status", "datetime").join(rows, "machine_name") \
        .select("machine_id", "machine_name", "status", "type", "datetime")
