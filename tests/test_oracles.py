"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql
from bound_queries import QUERIES
from compare import check, connect
from oracle_queries import ORACLES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, duck, folder, name):
    good, note = check(spark, duck, folder, name)
    assert good, note


def test_entry_returns_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "recommendation" in df.columns
