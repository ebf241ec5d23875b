"""Queries that SQL can express, against it."""

import pytest
from oracle import compare, connect

from quarry.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op3_mtree", "op8_tool_calls"])
def test_query(spark, name):
    d = "/root/testdata/sf0.01"
    assert compare(spark, connect(d), queries()[name], oracle_sql()[name], d) > 0
