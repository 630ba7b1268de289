"""Neighbours and places found in ranges equal those of a plain window."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from millwatch import schemas
from millwatch.operators import neighbours, ranges
from millwatch.operators.neighbours import with_neighbours
from millwatch.session import stored

ORDER = ["datetime", "machine_id", "status"]
START = datetime(2024, 1, 1)


def _plain(rows):
    w = Window.partitionBy("machine_name").orderBy(*ORDER)
    return rows.filter("datetime is not null").select(
        *rows.columns, F.lag("datetime").over(w).alias("prev_datetime"), F.lag("status").over(w).alias("prev_status"),
        F.lead("datetime").over(w).alias("next_datetime"), F.lead("type").over(w).alias("next_type"))


def _cut(rows):
    return with_neighbours(rows, "machine_name", ORDER, before=["datetime", "status"], after=["datetime", "type"])


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def _rows(spark, seed, n=600, machines=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        # machine 0 holds a third of the rows, most of them within one minute
        machine = 0 if rng.random() < 0.35 else rng.randrange(1, machines)
        second = 60 * 60 * 24 + rng.random() * 60 if machine == 0 and rng.random() < 0.8 else rng.random() * 7 * 86400
        name = None if machine == machines - 1 else f"Valve_0{machine}_01"
        when = None if rng.random() < 0.02 else START + timedelta(microseconds=int(second * 1e6) // 500_000 * 500_000)
        rows.append((rng.randrange(3), name, rng.choice(["operational", "warning", "down", None]), "valve", when))
    # a tie on the whole order would leave the neighbour open
    unique = {(r[0], r[1], r[2], r[4]): r for r in rows}
    return spark.createDataFrame(list(unique.values()), schemas.FEED)


@pytest.mark.parametrize("ranges", [1, 3, 8, 40])
def test_random_skewed_rows(spark, ranges, monkeypatch):
    _deal(monkeypatch, ranges)
    rows = _rows(spark, seed=ranges)
    assert _sorted(_cut(rows)) == _sorted(_plain(rows))


def _deal(monkeypatch, ranges):
    """So many ranges, however few the rows."""
    monkeypatch.setattr(neighbours, "in_ranges", lambda rows, columns: stored(
        rows.repartitionByRange(ranges, *columns).withColumn("_range", F.spark_partition_id()), "ranges"))


def test_without_adaptive_execution_and_broadcast_joins(spark):
    rows = _rows(spark, seed=6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _sorted(_cut(rows)) == _sorted(_plain(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=40, unique=True), st.integers(1, 6))
def test_any_small_table(spark, pairs, ranges):
    rows = spark.createDataFrame(
        [(i, f"m{m}", "down" if t % 2 else "operational", "valve", START + timedelta(hours=t))
         for i, (m, t) in enumerate(pairs)], schemas.FEED)
    with pytest.MonkeyPatch.context() as patch:
        _deal(patch, ranges)
        assert _sorted(_cut(rows)) == _sorted(_plain(rows))


def test_whole_numbers_as_order(spark, monkeypatch):
    _deal(monkeypatch, 6)
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", i * i) for i in range(50)], "seq bigint, k string, v bigint")
    got = with_neighbours(rows, "k", ["seq"], before=["v"])
    w = Window.partitionBy("k").orderBy("seq")
    assert _sorted(got) == _sorted(rows.select("*", F.lag("v").over(w).alias("prev_v")))


@pytest.mark.parametrize("ranges", [1, 4, 25])
def test_copies_of_one_reading(spark, ranges, monkeypatch):
    """Copies get the pairs of neighbours that a plain window gives them, also first and last of a run."""
    _deal(monkeypatch, ranges)
    monkeypatch.setattr(neighbours, "COPY_BLOCK", 7)
    moment = START + timedelta(hours=5)
    hot = [(1, "hot", "down", "valve", moment)] * 30 + [(1, "hot", "operational", "valve", moment)] * 2
    around = [(1, "hot", "warning", "valve", START + timedelta(hours=i)) for i in (1, 2, 5, 9)]
    cold = [(2, "cold", "down", "valve", moment)] * 3 + [(3, None, "down", "valve", moment)] * 9
    rows = spark.createDataFrame(hot + around + cold, schemas.FEED)
    assert _sorted(_cut(rows)) == _sorted(_plain(rows))


def test_a_burst_spreads_over_ranges(spark, monkeypatch):
    """1,000 readings within a millisecond among a hundred over a month."""
    rows = spark.createDataFrame(
        [(0, "hot", "down", "valve", START + timedelta(days=9, microseconds=i)) for i in range(1000)]
        + [(0, "hot", "down", "valve", START + timedelta(hours=7 * i)) for i in range(100)], schemas.FEED)
    _deal(monkeypatch, 20)
    placed = neighbours.in_ranges(rows, ["machine_name", *ORDER])
    assert max(r["count"] for r in placed.groupBy("_range").count().collect()) < 200
    assert _sorted(_cut(rows)) == _sorted(_plain(rows))


@pytest.mark.parametrize("weight", [None, "w"])
def test_places_in_ranges(spark, weight):
    rng = random.Random(4)
    names = [(rng.choice(["a", "b", None]), i, rng.randrange(1, 5)) for i in range(300)]
    got = ranges.with_start(spark.createDataFrame(names, "g string, i int, w bigint"), "g", ["i"], weight=weight).collect()
    for g in ("a", "b", None):
        at = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"]):
            assert r["start"] == at
            at += r["w"] if weight else 1
    assert len(got) == 300
