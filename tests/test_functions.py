"""Rounding and sums against exact arithmetic."""

import random
from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millwatch.functions.ratios import mean_hours, mean_of_cents, percent, ratio, scaled_ratio, sum_of_cents
from millwatch.functions.times import at, day_start, iso_text, micros_between, since, sum_micros


def _exact(n, d, places):
    if d == 0:
        return None
    value = Fraction(n, d) * 10 ** places
    whole = (abs(value) * 2 + 1) // 2
    return float((-whole if value < 0 else whole) / Fraction(10 ** places))


def test_ratio_rounds_half_away_from_zero(spark):
    rng = random.Random(7)
    pairs = [(1, 8), (-1, 8), (1, -8), (5, 1000), (-5, 1000), (0, 5), (7, 0), (0, 0), (201, 200), (2, 3), (10 ** 17, 3)]
    pairs += [(rng.randrange(-10 ** 6, 10 ** 6), rng.randrange(-400, 400)) for _ in range(500)]
    got = spark.createDataFrame(pairs, "n bigint, d bigint").select(
        "n", "d", ratio("n", "d").alias("two"), ratio("n", "d", 1).alias("one"), scaled_ratio("n", "d").alias("whole")).collect()
    for r in got:
        assert r["two"] == _exact(r["n"], r["d"], 2) and r["one"] == _exact(r["n"], r["d"], 1)
        assert r["whole"] is None or r["whole"] / 100 == r["two"]
    assert [str(r["two"]) for r in got if (r["n"], r["d"]) == (0, 5)] == ["0.0"]


def test_rounding_by_hand(spark):
    cases = [("1", "8", 0.13), ("-1", "8", -0.13), ("3", "8", 0.38), ("5", "1000", 0.01), ("4", "1000", 0.0), ("2", "3", 0.67),
             ("1", "-8", -0.13), ("201", "200", 1.01), ("1995", "1000", 2.0), ("7", "0", None)]
    row = spark.range(1).select(*[ratio(n, d) for n, d, _ in cases]).first()
    assert list(row) == [want for _, _, want in cases]
    assert tuple(spark.range(1).select(percent("1", "8"), percent("1", "7"), ratio("25", "100", 1)).first()) == (12.5, 14.29, 0.3)


def test_small_negative_is_plain_zero(spark):
    assert str(spark.range(1).select(ratio("-1", "1000")).first()[0]) == "0.0"


def test_percent_and_hours(spark):
    row = spark.range(1).select(percent("1", "3"), mean_hours("5400000000", "1"), mean_hours("null", "0")).first()
    assert tuple(row) == (33.33, 1.5, None)


def test_sum_of_durations_does_not_overflow(spark):
    big = 9 * 10 ** 18  # the plain sum of two of these leaves the range of a long
    total = spark.createDataFrame([(big,), (big,), (-5,), (None,)], "d bigint").agg(sum_micros("d")).first()[0]
    assert total == 2 * big - 5


def test_cents(spark):
    rows = spark.createDataFrame([(0.1,), (0.2,), (None,), (70.05,)], "v double")
    assert tuple(rows.agg(sum_of_cents("v"), mean_of_cents("v")).first()) == (70.35, 7035 / 3 / 100)


@pytest.mark.parametrize("moment, text", [
    (datetime(2024, 1, 31), "2024-01-31T00:00:00"), (datetime(2024, 1, 31, 1, 2, 3, 40), "2024-01-31T01:02:03.000040"), (None, None)])
def test_iso_text(spark, moment, text):
    got = spark.createDataFrame([(moment,)], "t timestamp_ntz").select(iso_text(F.col("t")), iso_text(F.col("t"), "+00:00")).first()
    assert tuple(got) == (text, text and text + "+00:00")


def test_clock(spark):
    now = datetime(2024, 1, 31, 15, 30)
    assert day_start(now) == datetime(2024, 1, 31) and day_start(now, 31) == datetime(2023, 12, 31)
    rows = spark.createDataFrame([(datetime(2024, 1, 24),), (datetime(2024, 1, 23, 23, 59, 59, 999999),), (None,)], "datetime timestamp_ntz")
    assert since(rows, "datetime", now, 7).count() == 1
    assert rows.select(micros_between(F.col("datetime"), at(now)).alias("m")).first()["m"] == (7 * 24 + 15.5) * 3600 * 10 ** 6
