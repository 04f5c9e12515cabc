"""Registered queries and the SQL that their rows are held against."""

from tidemark.plans import backtest, factors, gauge, lake, learning, quality, relational, scoring, strategy, valuation, xsec  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
