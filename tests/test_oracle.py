"""Every registered query against its DuckDB oracle, on the smallest supplied data."""
import os

import pytest

import __spark_entry__ as entry
from medwright.testing.compare import compare, duckdb_connection

from .conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="test data not present")

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    res = compare(df, con, ORACLE[name])
    assert res["match"], res
    assert res["types_match"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) == 19
