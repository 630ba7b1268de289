"""Full refresh of the gold tables."""

import pytest

from checks import registry, views
from checks.compare import connect, difference
from checks.oracle import GOLD
from conftest import SF
from millwatch.operators.latest import folded_variants, newest_variants
from millwatch.plans import gold
from millwatch.session import drop_scratch, scratch_dir, subfolders


@pytest.fixture(scope="module")
def root(spark):
    folder = scratch_dir(spark, "gold")
    feed, orders = views.machine_feed(spark, SF), views.work_orders(spark, SF)
    gold.refresh_gold(spark, feed.limit(3), orders, views.AS_OF, folder)
    # a second refresh is what readers see from then on
    gold.refresh_gold(spark, feed, orders, views.AS_OF, folder, variants=newest_variants(feed))
    return folder


@pytest.mark.parametrize("name", gold.GOLD_TABLES)
def test_refreshed_table(spark, root, name):
    assert difference(gold.read_gold(spark, root, name), connect(SF), GOLD[name]) is None


@pytest.mark.parametrize("name", gold.GOLD_TABLES)
def test_schema_is_the_one_stated(spark, root, name):
    from millwatch import schemas
    inputs, plan = gold.GOLD_TABLES[name]
    tables = {"feed": views.machine_feed(spark, SF), "work_orders": views.work_orders(spark, SF)}
    got = plan(*[tables[i] for i in inputs], views.AS_OF).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in schemas.GOLD[name]]


def test_machine_with_two_types_counts_twice_either_way(spark, feed_of, orders_of):
    feed = feed_of((1, "A_01_01", "down", "valve", "2024-01-30 10:00"), (1, "A_01_01", "operational", "sorter", "2024-01-30 11:00"),
                   (2, "B_01_01", "down", "valve", None), (2, "B_01_01", "operational", "valve", "2024-01-30 12:00"))
    wanted = None
    for variants in (None, newest_variants(feed), folded_variants(newest_variants(feed.limit(2)).unionByName(newest_variants(feed)))):
        root = scratch_dir(spark, "gold")
        gold.refresh_gold(spark, feed, orders_of(dict()), views.AS_OF, root, variants=variants)
        got = sorted(map(tuple, gold.read_gold(spark, root, "current_machine_status").collect()))
        assert sum(r[3] for r in got) == 3 and (wanted is None or got == wanted)
        wanted = got


def test_a_failed_refresh_leaves_the_published_version(spark, root, feed_of, orders_of, monkeypatch):
    before = gold.current_version(spark, root)
    monkeypatch.setattr(gold, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        gold.refresh_gold(spark, feed_of((1, "A_01_01", "down", "valve", "2024-01-30 10:00")), orders_of(dict()), views.AS_OF, root)
    assert gold.current_version(spark, root) == before


def test_unknown_table(spark, root):
    with pytest.raises(KeyError):
        gold.read_gold(spark, root, "machine_uptime_days")


def test_a_refresh_leaves_no_scratch(spark, root, feed_of, orders_of):
    feed = feed_of((1, "A_01_01", "down", "valve", "2024-01-30 10:00"), (1, "A_01_01", "operational", "valve", "2024-01-30 11:00"))
    folder = scratch_dir(spark, "gold")
    before = subfolders(spark, spark.conf.get("spark.checkpoint.dir"))
    gold.refresh_gold(spark, feed, orders_of({}), views.AS_OF, folder)
    assert set(subfolders(spark, spark.conf.get("spark.checkpoint.dir"))) - {folder.rsplit("/", 1)[1]} == set(before)
    assert gold.read_gold(spark, folder, "machine_uptime_7days").count() == 1


def test_tiles_survive_cleared_scratch(spark):
    tile = registry.TILES["tile_machine_count"]
    want = tile(spark, SF).collect()
    for path in registry._STORED.values():
        drop_scratch(spark, path)
    assert tile(spark, SF).collect() == want
