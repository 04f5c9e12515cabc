"""Where plans put their queries: a function of (spark, sf_dir) and the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name."""

    def held(f: Query) -> Query:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return held


def sixes(*columns: str) -> str:
    """SQL select items, each rounded to six places under its own name."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)
