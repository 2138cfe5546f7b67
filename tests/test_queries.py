"""Every registered query against its SQL on the smallest tables."""

import pytest

from keyspan.plans import oracle_sql, queries
from oracle import compare, duck

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(DIRECTORY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    if name in SQL:
        assert compare(spark, connection, DIRECTORY, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, DIRECTORY).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
