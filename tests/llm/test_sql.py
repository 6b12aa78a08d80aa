"""Queries whose whole result SQL can say."""

import os

import pytest
from oracle import check, connect

from gleaner.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    rows, differing = check(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert rows and not differing
