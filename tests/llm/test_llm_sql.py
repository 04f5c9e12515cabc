"""The numbered queries that SQL can express, against DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rounded(row) -> tuple:
    """A row with floats to nine places: sums are added up in another order."""
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(rounded, got.select(*columns).collect())) == Counter(map(rounded, want.fetchall()))
