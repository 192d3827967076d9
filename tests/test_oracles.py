"""Every query of the records engine against its SQL."""

import pytest
from oracle import both

from tidemark.jobs.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], ORACLES[name], SF)
    assert ours == theirs


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
