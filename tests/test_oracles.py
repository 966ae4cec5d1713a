"""Every query with an oracle gives the oracle's rows on the sample tables."""

import os

import pytest

from portolan.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = os.environ.get("PORTOLAN_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() >= 0
