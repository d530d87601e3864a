"""Every registered query with an oracle, compared value by value at the smallest scale."""

import pytest
from compare import connect, difference
from conftest import SMALL

from veilframe.plans.catalog import QUERIES
from veilframe.plans.oracles import oracles

ORACLES = oracles()


@pytest.fixture(scope="module")
def con():
    connection = connect(SMALL)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
