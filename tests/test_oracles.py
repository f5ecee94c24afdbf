"""Every registered query with SQL agrees with DuckDB."""

import pytest
from oracle import connect, differences

from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], con) == []
