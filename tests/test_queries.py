"""Every oracle-backed query against DuckDB at the smallest scale, and the driver's entry point."""

import pytest
from conftest import SF
from oracle_check import compare, connect

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


def test_registry_is_consistent():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"project", "id", "rank", "risk", "days_waited"} == set(rows[0].asDict())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(ORACLES[name]).df()
    assert compare(got, want) is None
