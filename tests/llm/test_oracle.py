"""Queries with SQL give DuckDB's rows on the smallest tables."""

import pytest

from graphloom.llm.queries import oracle_sql, queries
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = oracle.connect(SF)
    con.sql("SET TimeZone='UTC'")
    assert oracle.differences(queries()[name](spark, SF), con, oracle_sql()[name]) == ""
