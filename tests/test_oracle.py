"""Every registered query against its SQL twin; BOTICA_SF picks the data size."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import assert_same, connect

SF_DIR = os.environ.get("BOTICA_SF", "/root/testdata/sf0.001")
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()

# Searches whose subject need not exist at every data size.
MAY_BE_EMPTY = {"lookup_by_name"}


@pytest.fixture(scope="module")
def duck():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    if name not in ORACLE:
        assert result.count() > 0
        return
    rows = assert_same(result, duck, ORACLE[name])
    assert rows > 0 or name in MAY_BE_EMPTY


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
