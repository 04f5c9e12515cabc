"""The domain's tables, derived from the star schema, each beside the same derivation in DuckDB SQL.

A supplier is a ticker, its nation the industry and its region the sector. Bars are
shipments by supplier and day: prices are retail prices, spread by tax and discount.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import change
from tidemark.shared import laid_out

#: Bars with their returns that the parts of a query share, while it is put together.
_SHARED: ContextVar[dict[str, DataFrame] | None] = ContextVar("shared bars", default=None)
#: Columns that they have, if not all.
_COLUMNS: ContextVar[tuple[str, ...] | None] = ContextVar("columns of shared bars", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_once(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``plan`` with all its bars and returns read from one checkpointed table.

    Bars lie by ticker in order of date, so windows over them neither shuffle nor sort, whatever number of
    factors a plan is made of. A plan made inside another takes the outer one's table.
    """

    @wraps(plan)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _SHARED.get() is not None:
            return plan(spark, sf_dir)
        token = _SHARED.set({})
        try:
            return plan(spark, sf_dir)
        finally:
            _SHARED.reset(token)

    return run


def closes_once(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """:func:`bars_once` for a plan that reads no more than ticker, date, close and ret: the table has these four."""
    once = bars_once(plan)

    @wraps(plan)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _SHARED.get() is not None:
            return plan(spark, sf_dir)
        token = _COLUMNS.set(("ticker", "date", "close", "ret"))
        try:
            return once(spark, sf_dir)
        finally:
            _COLUMNS.reset(token)

    return run


def _held(name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """What ``made`` gives, checkpointed at first where bars are shared."""
    shared = _SHARED.get()
    if shared is None:
        return made()
    if name not in shared:
        shared[name] = laid_out(made().select(*(_COLUMNS.get() or ("*",))))
    return shared[name]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open, high, low, close, adj_close, volume."""
    return _bars(spark, sf_dir) if _SHARED.get() is None else returns(spark, sf_dir).drop("ret")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    if _SHARED.get() is not None:  # windows by ticker follow: lines are dealt out by it once, not by ticker and day first
        rows = rows.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "p_retailprice", "l_tax", "l_discount", "l_quantity").repartition("l_suppkey")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    return rows.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("p_retailprice", key).alias("open"),
        F.max(F.col("p_retailprice") * (1 + F.col("l_tax"))).alias("high"),
        F.min(F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("low"),
        F.max_by("p_retailprice", key).alias("close"),
        F.max_by("p_retailprice", key).alias("adj_close"),
        F.sum("l_quantity").alias("volume"),
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with ret, the return on the bar before (null at a ticker's first)."""
    return _held(f"returns {sf_dir}", lambda: _bars(spark, sf_dir).withColumn("ret", change(F.col("close"))))


def market(rets: DataFrame) -> DataFrame:
    """date and mkt, the mean return of all tickers."""
    return rets.where("ret IS NOT NULL").groupBy("date").agg(F.avg("ret").alias("mkt"))


def security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, name, sector, industry, equity."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), F.col("s_acctbal").alias("equity")
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, period (first day of the quarter), revenue, cost, tax, units, orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cost"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        F.sum("l_quantity").alias("units"),
        F.count_distinct("l_orderkey").alias("orders"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, customer, weight: pairs of suppliers in one order, by the orders they share.

    An order has a handful of lines, so the pairs of an order are few whatever the scale.
    """
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    other = pairs.select("l_orderkey", F.col("l_suppkey").alias("customer"))
    both = pairs.join(other, "l_orderkey").where("l_suppkey < customer")
    return both.groupBy(F.col("l_suppkey").alias("supplier"), "customer").agg(F.count("*").cast("double").alias("weight"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, other, weight (1): two suppliers in one order, from both ends, a row for each order: what :func:`edges` counts.

    Lines move once, by order; pairs are neither shuffled nor held.
    """
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    both = pairs.join(pairs.select("l_orderkey", F.col("l_suppkey").alias("other")), "l_orderkey").where("l_suppkey <> other")
    return both.select(F.col("l_suppkey").alias("ticker"), "other", F.lit(1.0).alias("weight"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, event_id."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, doc_id, headline: documents dealt to tickers by id."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 10 + 1).alias("ticker"), "doc_id", "text")


#: The same derivations in DuckDB SQL, to be named in a WITH clause.
BARS = """bars AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(p_retailprice, k) AS open, max(p_retailprice*(1+l_tax)) AS high,
         min(p_retailprice*(1-l_discount)) AS low, arg_max(p_retailprice, k) AS close, arg_max(p_retailprice, k) AS adj_close, sum(l_quantity) AS volume
  FROM (SELECT *, {'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey} AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""
RETS = BARS + """, rets AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM bars)"""
MARKET = RETS + """, market AS (SELECT date, avg(ret) AS mkt FROM rets WHERE ret IS NOT NULL GROUP BY 1)"""
SECURITY = """security AS (
  SELECT s_suppkey AS ticker, s_name AS name, r_name AS sector, n_name AS industry, s_acctbal AS equity
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FUNDAMENTALS = """fundamentals AS (
  SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, sum(l_extendedprice*(1-l_discount)) AS revenue,
         sum(l_extendedprice*l_discount) AS cost, sum(l_extendedprice*l_tax) AS tax, sum(l_quantity) AS units, count(DISTINCT l_orderkey) AS orders
  FROM lineitem GROUP BY 1, 2)"""
EDGES = """edges AS (
  SELECT a.l_suppkey AS supplier, b.l_suppkey AS customer, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b
    ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)"""
TICKS = """ticks AS (SELECT event_type AS symbol, ts, value AS price, event_id FROM events)"""
