"""Every registered query with SQL against DuckDB, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from leafquire import catalog
from oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
