"""Queries with SQL against it, on whole tables."""

import pytest
from compare import connect, differences

from spindrift.llm.oracle import ORACLE


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, name, directory):
    rows, different = differences(spark, connect(directory), directory, name)
    assert different == []
    assert rows > 0
