"""Clock and time arithmetic.

Every look-back starts at midnight of the ``as_of`` day.  Bounds are literals,
so they reach the Parquet scan as pushed filters.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND


def at(moment: datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.expr(f"timestamp_ntz'{moment.isoformat(sep=' ')}'")


def day_start(as_of: datetime, days: int = 0) -> datetime:
    """Midnight ``days`` days before the ``as_of`` day."""
    return datetime(as_of.year, as_of.month, as_of.day) - timedelta(days=days)


# Time column -> the day column that partitions the stored table.
DAY_PARTITIONS = {"datetime": "event_date", "created_at": "created_date"}


def since(rows: DataFrame, column: str, as_of: datetime, days: int) -> DataFrame:
    """Rows of the last ``days`` days; prunes the day partitions when the table has them."""
    start = day_start(as_of, days)
    day = DAY_PARTITIONS.get(column)
    if day in rows.columns:
        rows = rows.filter(F.col(day) >= F.lit(start.date()))
    return rows.filter(F.col(column) >= at(start))


def micros(column: Column) -> Column:
    """Microseconds since the epoch (sessions run in UTC)."""
    return F.unix_micros(column.cast("timestamp"))


def micros_between(start: Column, end: Column) -> Column:
    return micros(end) - micros(start)


def sum_micros(duration: str) -> Column:
    """Exact sum of durations, given as an SQL expression.

    Seconds and remainders add up apart, in longs, so that neither overflows at
    trillions of rows, and meet in a decimal afterwards.
    """
    seconds, rest = f"sum(({duration}) div {MICROS_PER_SECOND})", f"sum(({duration}) % {MICROS_PER_SECOND})"
    return F.expr(f"cast(cast({seconds} as decimal(30,0)) * {MICROS_PER_SECOND} + {rest} as decimal(38,0))")


def iso_text(column: Column, offset: str = "") -> Column:
    """ISO text; the fraction appears, with six digits, only when there is one."""
    text = F.replace(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(".000000"), F.lit(""))
    return F.concat(text, F.lit(offset)) if offset else text
