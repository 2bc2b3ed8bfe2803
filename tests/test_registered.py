"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect
from questline.queries import QUERIES

KEYS = sorted(QUERIES)  # the optional queries have tests of their own


@pytest.fixture(scope="module")
def database(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(KEYS) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, database, sf, key):
    assert compare(spark, database, contract.queries()[key], contract.oracle_sql()[key], sf) is None


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["statement_id", "full_prompt", "response"]
    assert rows.count() > 0
