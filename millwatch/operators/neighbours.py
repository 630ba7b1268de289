"""The reading before and after each reading of a machine, however many readings it has.

One path for every size.  Equal rows are counted first, combined on the map side.  The
counted rows are dealt out by ranges of (machine, time, the other columns), so that a
hot machine or a burst within a millisecond spreads over tasks, and the window runs
inside (range, machine).  Only the first and the last row of a machine in a range lack
a neighbour there; one row per range and machine closes those gaps.  At the end each
row is written out as often as it was counted: a copy inside a run has itself on both
sides, the first and the last copy also what lies around the run.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.operators.ranges import RANGE, in_ranges

# Copies that one task writes out at a time.
COPY_BLOCK = 100_000


def with_neighbours(rows: DataFrame, key: str, order: list[str], before: list[str] = (), after: list[str] = ()) -> DataFrame:
    """``rows`` plus ``prev_<c>`` for ``before`` and ``next_<c>`` for ``after``.

    Rows without ``order[0]`` are left out; rows equal in ``order`` follow their other
    columns; NULL keys are one machine.
    """
    columns, before, after = rows.columns, list(before), list(after)
    along = [*order, *[c for c in columns if c not in (*order, key)]]
    counted = rows.filter(F.col(order[0]).isNotNull()).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    return neighbours_in_ranges(in_ranges(counted, [key, *along]), columns, key, along, before, after)


def neighbours_in_ranges(placed: DataFrame, columns: list[str], key: str, along: list[str], before: list[str], after: list[str]) -> DataFrame:
    """The same for counted rows (``_copies``) that are in ranges already.

    Along a key, ranges ascend with ``along``; a range may hold any number of keys.
    """
    inside = Window.partitionBy(RANGE, key).orderBy(*along)
    sides = [*[F.lag(c).over(inside).alias(f"prev_{c}") for c in before], *[F.lead(c).over(inside).alias(f"next_{c}") for c in after]]
    found = placed.select(*columns, "_copies", RANGE, F.lag(F.lit(True)).over(inside).isNull().alias("_opens"),
                          F.lead(F.lit(True)).over(inside).isNull().alias("_closes"), *sides)
    found = _close_gaps(found, key, before, after)
    return _write_copies(found, columns, before, after)


def _close_gaps(found: DataFrame, key: str, before: list[str], after: list[str]) -> DataFrame:
    """Fill in what lies beyond the ends of each range: the nearest row of the machine in another range."""
    image = lambda names: F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in names])
    ends = found.filter("_opens or _closes").groupBy(RANGE, key).agg(
        F.first(F.when(F.col("_opens"), image(after)), ignorenulls=True).alias("_first"),
        F.first(F.when(F.col("_closes"), image(before)), ignorenulls=True).alias("_last"))
    along = Window.partitionBy(key).orderBy(RANGE)
    ends = ends.select(F.col(RANGE).alias("_r"), F.col(key).alias("_k"),
                       F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    joined = found.join(ends, (F.col(RANGE) == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left")

    def closed(side: str, at_end: str, edge: str, c: str) -> Column:
        return F.when(F.col(at_end), F.col(f"{edge}.{c}")).otherwise(F.col(f"{side}_{c}")).alias(f"{side}_{c}")

    kept = [c for c in found.columns if c not in (RANGE, "_opens", "_closes") and not c.startswith(("prev_", "next_"))]
    return joined.select(*kept, *[closed("prev", "_opens", "_before", c) for c in before],
                         *[closed("next", "_closes", "_after", c) for c in after])


def _write_copies(found: DataFrame, columns: list[str], before: list[str], after: list[str]) -> DataFrame:
    """Each row as often as it was counted, with the neighbours of its place in the run."""
    single, first, last = F.col("_copies") == 1, F.col("_part") == 0, F.col("_part") == 1
    ends = found.withColumn("_part", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).select(
        *columns,
        *[F.when(first, F.col(f"prev_{c}")).otherwise(F.col(c)).alias(f"prev_{c}") for c in before],
        *[F.when(single | last, F.col(f"next_{c}")).otherwise(F.col(c)).alias(f"next_{c}") for c in after])
    blocks = found.filter("_copies > 2").select(
        *columns, "_copies", F.explode(F.expr(f"sequence(0L, (_copies - 3) div {COPY_BLOCK})")).alias("_block"))
    size = F.expr(f"least({COPY_BLOCK}L, _copies - 2 - _block * {COPY_BLOCK})")
    inner = blocks.hint("rebalance").select(
        *columns, F.explode(F.array_repeat(F.lit(1), size.cast("int"))).alias("_copy")).select(
        *columns, *[F.col(c).alias(f"prev_{c}") for c in before], *[F.col(c).alias(f"next_{c}") for c in after])
    return ends.unionByName(inner)
