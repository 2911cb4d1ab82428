"""Every registered query that has DuckDB SQL matches it at sf0.01 (names,
row count, values).  Set ORACLE_SUBSET=name1,name2 to run a few."""

import os

import pytest

import __spark_entry__ as entry
from scoreforge.checks.compare import compare, duck

from conftest import SF01

SQL = entry.oracle_sql()
QUERIES = entry.queries()
NAMES = sorted(n for n in QUERIES if n in SQL)
if os.environ.get("ORACLE_SUBSET"):
    NAMES = [n for n in NAMES if n in os.environ["ORACLE_SUBSET"].split(",")]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_is_registered_with_a_known_id():
    assert len(QUERIES) >= 60
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    res = compare(spark, SF01, name, QUERIES[name], SQL[name], con)
    assert res["cols_match"], res
    assert res["rows_spark"] == res["rows_sql"], res
    assert res["values_match"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["tier", "n"] and sum(r["n"] for r in rows) == 6000
