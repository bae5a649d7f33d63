"""Every query with SQL must give the SQL's rows (smallest tables; the larger ones by check_oracles.py)."""

import pytest

import check_oracles
from assaykit.plans.catalog import load

CATALOG = load()


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("key", [k for k, e in CATALOG.items() if e.sql])
def test_oracle(spark, con, sf, key):
    note = check_oracles.compare(spark, con, CATALOG[key], sf)
    assert note.startswith("ok"), note


def test_entry_points(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
