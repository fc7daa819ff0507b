"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from graphloom.plans.queries import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = oracle.connect(SF)
    con.sql("SET TimeZone='UTC'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""
