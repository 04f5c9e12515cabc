"""Portfolios solved in groups: each universe's signals and price history go to a task of their own.

A universe is a rebalance date under one method. What a group holds is bounded by the
names a universe takes (``top``) and by a year of their closes; dates and methods run
side by side, and no matrix comes to the driver.
"""

from __future__ import annotations



import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.plugins import OPTIMISERS

#: Names of a universe, days of history before it, trading days a year, and the least weight that is kept.
TOP = 50
DAYS = 365
YEAR = 252
LEAST = 0.001


def chosen(signals: DataFrame, dates: DataFrame, models: tuple[str, ...], top: int = TOP) -> DataFrame:
    """as_of, model_name, date, ticker, score, ...: for each date the best ``top`` signals of the first model that has any.

    A date's own signals come first, by the order of ``models``; where there are none,
    each model's newest ones before it, in the same order. Ties go to the lower ticker;
    null scores are no signals.
    """
    order = F.coalesce(*[F.when(F.col("model_name") == m, k) for k, m in enumerate(models)])
    held = signals.where(F.col("model_name").isin(*models) & F.col("score").isNotNull())
    asked = dates.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model_name"), F.col("as_of").alias("_at"), F.lit(True).alias("_asked")).distinct()
    there = held.select("model_name", F.col("date").alias("_at"), F.lit(False)).distinct()
    so_far = Window.partitionBy("model_name").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    newest = asked.union(there).withColumn("date", F.max(F.when(~F.col("_asked"), F.col("_at"))).over(so_far)).where("_asked AND date IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("_at").orderBy((F.col("date") < F.col("_at")).cast("int"), order))
    best = newest.withColumn("_k", rank).where("_k = 1").select(F.col("_at").alias("as_of"), "model_name", "date")
    rows = held.join(best, ["model_name", "date"])
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "ticker"))
    return rows.withColumn("_k", place).where(F.col("_k") <= top).drop("_k")


def histories(universes: DataFrame, bars: DataFrame, days: int = DAYS) -> DataFrame:
    """universes (as_of, ticker, ...) with closes: each name's (date, close) of the ``days`` up to as_of, in order; of a day's closes the greatest.

    A date meets the bars of the months that ``days`` reach back to, by month and ticker: dates have few names, so bars are read once as they are.
    """

    def month(d: str) -> Column:
        return F.year(d) * 12 + F.month(d)

    near = bars.where("close IS NOT NULL").select("ticker", F.col("date").alias("_date"), "close", month("date").alias("_month"))
    wanted = universes.select("as_of", "ticker").distinct()
    wanted = wanted.select("as_of", "ticker", F.explode(F.sequence(month(F.date_sub("as_of", days)), month("as_of"))).alias("_month"))
    met = wanted.join(near, ["ticker", "_month"]).where((F.col("_date") <= F.col("as_of")) & (F.col("_date") > F.date_sub("as_of", days)))
    daily = met.groupBy("as_of", "ticker", "_date").agg(F.max("close").alias("close"))
    closes = daily.groupBy("as_of", "ticker").agg(F.array_sort(F.collect_list(F.struct(F.col("_date").alias("date"), "close"))).alias("closes"))
    return universes.join(closes, ["as_of", "ticker"], "left")


def returns_of(closes: list) -> tuple[np.ndarray, np.ndarray]:
    """Which names have closes, and their returns by date: closes are carried forward from where all names have begun."""
    has = np.array([bool(c) for c in closes])
    kept = [c for c in closes if c]
    if not kept:
        return has, np.zeros((0, 0))
    dates = sorted({d["date"] for c in kept for d in c})
    place = {d: k for k, d in enumerate(dates)}
    table = np.full((len(dates), len(kept)), np.nan)
    for j, c in enumerate(kept):
        for d in c:
            table[place[d["date"]], j] = d["close"]
    table = pd.DataFrame(table).ffill().dropna().to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        moves = table[1:] / table[:-1] - 1
    return has, moves[np.isfinite(moves).all(axis=1)]


def vol_scale(weights: np.ndarray, moves: np.ndarray, target: float, span: int = 20, most: float = 2.0) -> float:
    """Target over the book's forecast volatility, at most ``most``; 1 where history is too short or does not move.

    The forecast is the exponentially weighted deviation of the book's returns over a
    span, with adjusted weights and the bias taken out, in years.
    """
    book = moves @ weights
    if len(book) < span:
        return 1.0
    now = pd.Series(book).ewm(span=span).std().iloc[-1] * YEAR**0.5
    return 1.0 if not np.isfinite(now) or now == 0 else float(min(target / now, most))


def solved(method: str, score: np.ndarray, caps: np.ndarray, moves: np.ndarray) -> tuple[str, np.ndarray]:
    """The method that gave weights, and the weights: a method that can't goes on to its next one, at last to equal weights."""
    cov = np.atleast_2d(np.cov(moves, rowvar=False)) * YEAR if len(moves) > 1 else np.zeros((len(score),) * 2)
    tried = []
    while method in OPTIMISERS and method not in tried:
        tried.append(method)
        plugin = OPTIMISERS.get(method)
        try:
            weights = plugin.optimise(score, cov, caps)
        except (ValueError, np.linalg.LinAlgError):
            weights = None
        if weights is not None and np.isfinite(weights).all() and weights.sum() > 0:
            weights = np.where(weights < LEAST, 0.0, weights)
            if weights.sum() > 0:
                return method, weights / weights.sum()
        method = plugin.otherwise
    return "equal", np.full(len(score), 1 / len(score))


def optimised(universes: DataFrame, bars: DataFrame, target_vol: float | None = None, confidence: float = 1.0) -> DataFrame:
    """as_of, method, used, ticker, weight, scale of each universe (as_of, method, ticker, score, cap).

    Names without closes in the year before are left out. ``used`` is the method that gave
    the weights. With a target volatility (times the confidence in the system) weights
    are scaled by ``scale``; else that is 1. Weights below a thousandth are 0 before
    scaling, and rows of weight 0 are kept, so that a reader sees which names were there.
    """
    held = histories(universes, bars).select("as_of", "method", "ticker", "score", "cap", "closes")
    kind = held.schema["ticker"].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("ticker")
        has, moves = returns_of(group.column("closes").to_pylist())
        group = group.filter(pa.array(has))
        n = group.num_rows
        columns = {"used": pa.array([], pa.string()), "weight": pa.array([], pa.float64()), "scale": pa.array([], pa.float64())}
        if n:
            score, caps = (np.array(group.column(c).cast(pa.float64()).to_pylist(), float) for c in ("score", "cap"))
            used, weights = solved(group.column("method")[0].as_py(), score, caps, moves)
            scale = vol_scale(weights, moves, target_vol * confidence) if target_vol else 1.0
            columns = {"used": pa.array([used] * n), "weight": pa.array(weights * scale), "scale": pa.array(np.full(n, scale))}
        return pa.table({"as_of": group.column("as_of"), "method": group.column("method"), "used": columns["used"], "ticker": group.column("ticker"), "weight": columns["weight"], "scale": columns["scale"]})

    return held.groupBy("as_of", "method").applyInArrow(solve, f"as_of date, method string, used string, ticker {kind}, weight double, scale double")


def trade_list(targets: DataFrame, bars: DataFrame, names: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """as_of, ticker, name, sector, action, weight, price, shares, value: what to trade to come from the targets before to these.

    Weights up to a thousandth count as none; a name that falls out is sold to nothing.
    Shares are whole; prices are the last closes up to the date.
    """
    wide = targets.where(F.col("weight") > LEAST).select("as_of", "ticker", "weight")
    dates = targets.select("as_of").distinct().withColumn("before", F.lag("as_of").over(Window.orderBy("as_of")))
    old = wide.select(F.col("as_of").alias("before"), "ticker", F.col("weight").alias("was")).join(dates, "before")
    moved = wide.join(old.drop("before"), ["as_of", "ticker"], "full_outer").na.fill(0.0, ["weight", "was"])
    near = bars.where("close IS NOT NULL").join(moved.select("as_of", "ticker"), "ticker").where(F.col("date") <= F.col("as_of"))
    price = near.groupBy("as_of", "ticker").agg(F.max_by("close", "date").alias("price"))
    action = F.when(F.col("was") == 0, "BUY").when(F.col("weight") == 0, "SELL").when(F.col("weight") > F.col("was"), "ADD").when(F.col("weight") < F.col("was"), "TRIM").otherwise("HOLD")
    rows = moved.join(price, ["as_of", "ticker"]).where("price > 0").join(names.select("ticker", "name", "sector"), "ticker", "left")
    shares = F.floor(F.col("weight") * capital / F.col("price"))
    return rows.select("as_of", "ticker", "name", F.coalesce("sector", F.lit("Unknown")).alias("sector"), action.alias("action"), "weight", "price", shares.alias("shares"), (shares * F.col("price")).alias("value"))
