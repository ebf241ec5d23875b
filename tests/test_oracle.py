"""Every catalogue query against its SQL."""

import pytest
from oracle import compare, connect

from quarry.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    n = compare(spark, connect(SF), queries()[name], oracle_sql()[name], SF)
    if not any(s in name for s in ("impossible", "zero", "bad", "literal", "operator", "not_alone", "reversed", "name_scope", "negative")):
        assert n > 0
