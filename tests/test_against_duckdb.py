"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import connect, difference
from checks.views import AS_OF
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["problematic_machines_30days", "hourly_status_patterns"])
def test_look_back_that_cuts_the_feed(spark, con, name):
    """At this later clock the 30-day filter removes readings."""
    from datetime import datetime
    from checks import views
    from millwatch.plans.gold import GOLD_TABLES
    later = datetime(2024, 2, 10)
    sql = entry.oracle_sql()[name].replace("2024-01-01 00:00:00", "2024-01-11 00:00:00") \
        .replace(f"timestamp '{AS_OF}' as last_updated", f"timestamp '{later}' as last_updated")
    _, plan = GOLD_TABLES[name]
    assert difference(plan(views.machine_feed(spark, SF), later), con, sql) is None
