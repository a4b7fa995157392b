"""Every registered query against its DuckDB oracle (row count, columns,
order-insensitive values) on the smallest test tables."""

import os

import pytest

from oracle_check import compare, duck
from sparkprep.plans.registry import all_queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    q = QUERIES[name]
    r = compare(spark, name, q.build, q.sql, SF, con)
    assert r["ok"], r
