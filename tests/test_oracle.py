"""Every registered query against DuckDB on the same tables."""

import os

import pytest
from compare import check, connect

from terraspan.plans.queries import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches(spark, con, name):
    check(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
