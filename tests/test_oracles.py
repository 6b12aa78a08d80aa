"""Every registered query against its DuckDB oracle on whole tables."""

import os

import pytest
from oracle import check, connect

from queries import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, FOLDER).columns
        return
    _, differing = check(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert not differing
