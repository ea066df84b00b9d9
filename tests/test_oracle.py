"""Registered queries against their DuckDB oracle on the smallest tables (fast subset)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import compare  # noqa: E402
from wordloom.plans.common import TABLES  # noqa: E402
from wordloom.plans.registry import oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF, name, queries()[name], oracle_sql()[name], con)
    assert r["match"], r
