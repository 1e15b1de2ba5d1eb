"""Opt-in larger-scale oracle check (set MEDWRIGHT_SLOW=1): the headline
reports at sf0.1 against DuckDB."""
import os

import pytest

import __spark_entry__ as entry
from medwright.testing.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(os.environ.get("MEDWRIGHT_SLOW") != "1" or not os.path.exists(SF),
                                reason="set MEDWRIGHT_SLOW=1 to run the sf0.1 oracle checks")

HEAVY = ["Q1", "Q2", "Q2_post", "Q3", "Q4", "Q4_log", "Q5", "Q6", "Q7", "Q7_year", "Q8", "Q8_clean",
         "Q8_intervention", "W1", "W3"]


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.parametrize("name", HEAVY)
def test_heavy_query_matches_oracle_at_sf01(spark, con, name):
    res = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert res["match"] and res["types_match"], res
