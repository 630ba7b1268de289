"""Exact rounding, half away from zero, carried out in integers.

Arguments are SQL expressions over the columns at hand.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rounded(numerator: str, denominator: str | int, places: int) -> str:
    n, d = (f"cast({x} as decimal(38,0))" for x in (numerator, denominator))
    size = f"((abs({n}) * {2 * 10 ** places} + abs({d})) div nullif(abs({d}) * 2, 0))"
    return f"if(({n} < 0) <> ({d} < 0), -{size}, {size})"


def scaled_ratio(numerator: str, denominator: str | int, places: int = 2) -> Column:
    """``numerator / denominator`` as a whole number of 10^-places; NULL over zero."""
    return F.expr(_rounded(numerator, denominator, places))


def ratio(numerator: str, denominator: str | int, places: int = 2) -> Column:
    """``numerator / denominator`` rounded to ``places`` digits, as a double."""
    # divided as a decimal: hundredths beyond 2^53 would lose digits on the way to a double
    return F.expr(f"cast(cast({_rounded(numerator, denominator, places)} as decimal(20,0)) / {10 ** places} as double)")


def percent(part: str, total: str) -> Column:
    return ratio(f"(cast({part} as decimal(38,0)) * 100)", total)


def mean_hours(total_micros: str, count: str) -> Column:
    """Average of ``count`` durations, in hours, two digits; NULL when there are none."""
    return ratio(total_micros, f"(cast({count} as decimal(38,0)) * 3600000000)")


def mean_of_cents(column: str) -> Column:
    """Average of a two-digit double, summed exactly in hundredths."""
    return F.expr(f"sum(cast(round({column} * 100D) as bigint)) / count({column}) / 100D")


def sum_of_cents(column: str) -> Column:
    """Sum of a two-digit double, exact in hundredths."""
    return F.expr(f"sum(cast(round({column} * 100D) as bigint)) / 100D")
