"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences, plans_cut
from spindrift.plans.catalog import QUERIES
from spindrift.plans.oracle import ORACLE

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    """Right rows, and no plan on the way to them that pairs rows without a key."""
    with plans_cut() as plans:
        rows, different = differences(spark, con, DIRECTORY, name, plans)
    assert different == []
    assert rows > 0
    assert not [p for p in plans if "NestedLoop" in p or "Cartesian" in p]


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert entry_points.queries().keys() >= QUERIES.keys()
    assert entry_points.oracle_sql().keys() >= ORACLE.keys()


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["id", "url", "outcome"]
    assert df.count() > 0
