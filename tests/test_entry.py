"""Driver contract: entry smoke test and every oracle query against DuckDB (sf0.001)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SMOKE = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "label" in df.columns


def test_contract_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMOKE)
    assert info["ok"], info
