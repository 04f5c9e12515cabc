"""Every query of the library: those that SQL can express against DuckDB over the same tables, the others for their rows."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries whose results come from solvers, learning or streams, which SQL cannot express.
WITHOUT_SQL = sorted(QUERIES.keys() - SQL.keys())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    """A value as it is compared: integers as they are, other numbers to nine digits, times as text."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float | Decimal):
        return float(f"{float(value):.9g}") + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return str(value)


def close(a, b) -> bool:
    """Integers are compared exactly; an integer beside a fraction is compared as one."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, int) and isinstance(b, int):
        return a == b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, isinstance(x, str), f"{x:.5g}" if isinstance(x, int | float) else str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    mine, theirs = ordered(got.select(*[f"`{c}`" for c in columns]).collect()), ordered(want.fetchall())
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if not close(a, b)]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_has_rows(spark, name):
    got = QUERIES[name](spark, SF)
    assert len(got.columns) == len(set(got.columns))
    assert got.count() > 0
