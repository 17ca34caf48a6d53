"""Operators that SQL can express against their DuckDB statements."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare
from cohortspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_matches_its_statement(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    problems, n = compare(entry.queries()[key](spark, SF), con, entry.oracle_sql()[key])
    assert not problems and n, problems
