"""Every registered query against its SQL on the small test tables."""

import pytest

import __spark_entry__ as entry
from pactframe.plans.registry import all_oracles, all_queries
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()
# On the smallest tables the user's accounts have no documents.
MAY_BE_EMPTY = {"tenant_documents"}


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, oracle, key):
    result = QUERIES[key](spark, FOLDER)
    if key not in ORACLES:
        assert result.count() > 0
        return
    found = differences(result, oracle, ORACLES[key])
    if key in MAY_BE_EMPTY:
        found = [f for f in found if f != "both sides are empty"]
    assert not found, found


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
