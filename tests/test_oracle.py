"""Every catalogue query against its DuckDB SQL oracle at sf0.001 (the driver
repeats this at sf0.01)."""

import pytest

from conftest import SF001
from oracle_check import compare, duck
from taxomatch.plans.catalogue import QUERIES
from taxomatch.plans.oracle import oracle_sql

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    msg, ok = compare(spark, con, key, QUERIES[key], SQL.get(key), SF001)
    assert ok, msg
