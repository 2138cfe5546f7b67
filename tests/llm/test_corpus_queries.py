"""Corpus queries with SQL, against it."""

import pytest

from keyspan.llm.queries import oracle_sql, queries
from oracle import compare, duck

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    assert compare(spark, duck(DIRECTORY), DIRECTORY, queries()[name], oracle_sql()[name]) is None
