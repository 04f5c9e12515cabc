"""Relational operators over bars and statements: point-in-time reads, as-of joins, resampling, turnover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days after which a fact is known, by its kind.
LAGS = {"price": 1, "fundamental": 45, "fundamental_late": 60, "estimate": 1, "news": 0}


def price_range(bars: DataFrame, tickers: list, start: str, end: str, fields: list[str]) -> DataFrame:
    """Chosen fields of some tickers between two dates, both included."""
    rows = bars.where(F.col("ticker").isin(tickers) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.select("ticker", "date", *fields)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: one aggregation with partial sums, no sort of the group."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (*keys, order)])).alias("r")).select(*keys, "r.*")


def narrow(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: one row for each metric of a wide row."""
    return rows.unpivot(keys, metrics, "metric", "value")


def wide(eav: DataFrame, key: str, order: str, metrics: list[str]) -> DataFrame:
    """The last value of each metric as a column."""
    return eav.groupBy(key).pivot("metric", metrics).agg(F.max_by("value", order))


def visible(rows: DataFrame, date: str, as_of: str, lag: int) -> DataFrame:
    """Rows whose facts are known by ``as_of``: dated no later than lag days before."""
    return rows.where(F.col(date) <= F.date_sub(F.lit(as_of).cast("date"), lag))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], seen: str) -> DataFrame:
    """Each left row with the values of the last right row at or before it, and that row's order as ``seen``.

    Both sides are one union sorted once by key and order; no range join.
    """
    held = F.struct(F.col(order).alias(seen), *values)
    both = left.select(*left.columns, F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_held"), F.lit(1).alias("_side"))
    both = both.unionByName(right.select(*keys, order, held.alias("_held"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_held", F.last("_held", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, "_held.*")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], days: int, seen: str) -> DataFrame:
    """Each left row with the right row nearest in days, at most ``days`` away, the earlier of two as near.

    Days are cut into spans of the window's width; a right row meets its own and both neighbouring spans by equality.
    """
    span = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (2 * days))
    near = right.select(*keys, F.col(order).alias(seen), *values, F.explode(F.array(*[span(F.col(order)) + k for k in (-1, 0, 1)])).alias("_span"))
    both = left.withColumn("_span", span(F.col(order))).join(near, [*keys, "_span"]).where(F.abs(F.datediff(seen, order)) <= days)
    best = F.min(F.struct(F.abs(F.datediff(seen, order)).alias("_far"), seen, *values)).alias("_best")
    return both.groupBy(*left.columns).agg(best).select(*left.columns, f"_best.{seen}", *[f"_best.{v}" for v in values])


def missing_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """ticker, date: expected days on which a ticker has no row.

    The expected days travel as one array with each ticker, so no product is shuffled.
    """
    expected = days.agg(F.sort_array(F.collect_set("date")).alias("days"))
    held = rows.select("ticker", "date")
    asked = held.select("ticker").distinct().join(F.broadcast(expected)).select("ticker", F.explode("days").alias("date"))
    return asked.join(held, ["ticker", "date"], "left_anti")


def turnover(held: DataFrame, period: str) -> DataFrame:
    """Half the absolute change of weights (ticker, period, weight) from one period to the next."""
    before = held.select("ticker", (F.col(period) + 1).alias(period), F.col("weight").alias("was"))
    both = held.join(before, ["ticker", period], "full_outer")
    return both.groupBy(period).agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))) / 2).alias("turnover"))


def both_ways(edges: DataFrame) -> DataFrame:
    """ticker, other, weight: each edge seen from both of its ends."""
    return edges.select(F.col("supplier").alias("ticker"), F.col("customer").alias("other"), "weight").union(edges.select("customer", "supplier", "weight"))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in a total order; Spark prunes groups before the shuffle."""
    found = rows.withColumn(rank or "_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank or "_k") <= k)
    return found if rank else found.drop("_k")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in a total order."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def nth_from_last(rows: DataFrame, value: str, places: dict[str, int]) -> DataFrame:
    """ticker and the values at places counted from a ticker's last row (1 is the last)."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    numbered = rows.select("ticker", value, F.row_number().over(w).alias("k")).where(F.col("k") <= max(places.values()))
    return numbered.groupBy("ticker").agg(*[F.max(F.when(F.col("k") == k, F.col(value))).alias(n) for n, k in places.items()])


def covariances(rows: DataFrame) -> DataFrame:
    """t1, t2, days, cov, corr of every pair of tickers (ticker, date, r) over their common dates.

    The matrix has a row for each pair by its nature: choose the tickers before.
    """
    a = rows.select("date", F.col("ticker").alias("t1"), F.col("r").alias("r1"))
    b = rows.select("date", F.col("ticker").alias("t2"), F.col("r").alias("r2"))
    both = a.join(b, "date").where("t1 <= t2")
    return both.groupBy("t1", "t2").agg(F.count("*").alias("days"), F.covar_samp("r1", "r2").alias("cov"), F.corr("r1", "r2").alias("corr"))


def resampled(bars: DataFrame, unit: str) -> DataFrame:
    """ticker, date (first day of the unit), close (the last of it)."""
    return bars.groupBy("ticker", F.to_date(F.date_trunc(unit, "date")).alias("date")).agg(F.max_by("close", "date").alias("close"))


def mean_of_present(*columns: Column) -> Column:
    """The mean of the columns that aren't null; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, n)


def winsorised(rows: DataFrame, by: list[str], columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns held between two percentiles of their group."""
    ends = rows.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in columns])
    out = rows.join(ends, by)
    return out.select(*[F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_{c}")[0], F.least(F.col(f"_{c}")[1], F.col(c)))).alias(c) if c in columns else F.col(c) for c in rows.columns])


def last_known(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key and of each column its last value that isn't null, which may be of different rows."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def leaks(as_of: str, target: str) -> Column:
    """Whether a row's facts are of later than the day they are used for."""
    return F.col(as_of) > F.col(target)


def asserted(rows: DataFrame, as_of: str, target: str) -> DataFrame:
    """rows, and a failing job should one of them look ahead."""
    message = F.concat(F.lit("facts of "), F.col(as_of).cast("string"), F.lit(" used for "), F.col(target).cast("string"))
    return rows.where(F.assert_true(~leaks(as_of, target), message).isNull())


def needed_from(start: Column, lookback: int = 252) -> tuple[Column, Column]:
    """The first days from which fundamentals and prices are needed to start a backtest on a day."""
    return F.date_sub(start, LAGS["fundamental"] + lookback), F.date_sub(start, lookback)


def active(flag: str) -> Column:
    """Whether a row is active; one that doesn't say so is."""
    return F.coalesce(F.col(flag), F.lit(True))


def converted(amounts: DataFrame, rates: DataFrame, amount: str, into: str) -> DataFrame:
    """amounts (currency) with ``amount`` in the currency ``into`` by rates (currency, per_unit); one without a rate is null."""
    rows = amounts.join(rates, "currency", "left")
    return rows.withColumn(amount, F.when(F.col("currency") == into, F.col(amount)).otherwise(F.col(amount) * F.col("per_unit"))).drop("per_unit")


def positive_sum(weights: str) -> Column:
    """The sum of a map's positive values."""
    return F.aggregate(F.filter(F.map_values(weights), lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
