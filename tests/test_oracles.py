"""Every named query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from tallyframe.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES) and set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], ORACLES[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
