"""Backtest measures as windows and aggregates; sequential engines as grouped folds over small states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import norm_cdf, norm_ppf, ratio
from tidemark.functions.windows import whole
from tidemark.operators.engine import days


def index_level(market: DataFrame, ret: str) -> DataFrame:
    """date, level: a series compounded. One row a day, so one ordered window over the calendar is small whatever the bars."""
    return market.select("date", F.exp(F.sum(F.ln(1 + F.col(ret))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).alias("level"))


def performance(rows: DataFrame, key: str, order: str, ret: str, periods: float, rate: float = 0.0) -> DataFrame:
    """key, n, total, annual, vol, sharpe, max_drawdown, hit_rate of a return series of each key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    growth = rows.select(key, order, ret, F.exp(F.sum(F.ln(1 + F.col(ret))).over(w)).alias("g"))
    growth = growth.withColumn("dd", F.col("g") / F.greatest(F.max("g").over(w), F.lit(1.0)) - 1)
    out = growth.groupBy(key).agg(
        F.count("*").alias("n"), (F.max_by("g", order) - 1).alias("total"), F.stddev_samp(ret).alias("sd"), F.avg(ret).alias("mean"),
        F.least(F.min("dd"), F.lit(0.0)).alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
    )
    return out.select(
        key, "n", "total", (F.pow(1 + F.col("total"), periods / F.col("n")) - 1).alias("annual"), (F.col("sd") * periods**0.5).alias("vol"),
        ratio((F.col("mean") - rate / periods) * periods**0.5, F.col("sd")).alias("sharpe"), "max_drawdown", "hit_rate",
    )


def against_benchmark(rows: DataFrame, key: str, ret: str, bench: str, periods: int = 252, least: int = 20) -> DataFrame:
    """key, beta, alpha, tracking_error, information_ratio of aligned returns, with ``least`` of them at least."""
    active = F.col(ret) - F.col(bench)
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"), ratio(F.covar_samp(ret, bench), F.var_samp(bench)).alias("beta"), F.avg(ret).alias("r"), F.avg(bench).alias("b"),
        F.stddev_samp(active).alias("te"), F.avg(active).alias("a"),
    ).where(F.col("n") >= least)
    return out.select(
        key, "beta", ((F.col("r") - F.col("beta") * F.col("b")) * periods).alias("alpha"), (F.col("te") * periods**0.5).alias("tracking_error"),
        ratio(F.col("a") * periods**0.5, F.col("te")).alias("information_ratio"),
    )


def sharpe_statistics(rows: DataFrame, key: str, ret: str, trials: int = 10, target: float = 0.0) -> DataFrame:
    """key, sharpe, psr, dsr: the probability that the true ratio exceeds a target, and the best of ``trials`` by luck."""
    s = rows.groupBy(key).agg(F.count(ret).alias("n"), ratio(F.avg(ret), F.stddev_samp(ret)).alias("sr"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt"))
    spread = F.sqrt((1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / (F.col("n") - 1))
    euler = 0.5772156649015329
    luck = F.lit(0.0) if trials <= 1 else spread * ((1 - euler) * norm_ppf(F.lit(1 - 1 / trials)) + euler * norm_ppf(F.lit(1 - 1 / (trials * 2.718281828459045))))
    return s.select(key, F.col("sr").alias("sharpe"), norm_cdf((F.col("sr") - target) / spread).alias("psr"), norm_cdf((F.col("sr") - luck) / spread).alias("dsr"))


def purged_folds(rows: DataFrame, key: str, k: int = 5, embargo: float = 0.01, horizon: int = 20) -> DataFrame:
    """key, date, fold, role: each row in each fold as test, train, purged (its label reaches into the test) or embargoed."""
    w = Window.partitionBy(key).orderBy("date")
    placed = rows.select(key, "date", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(whole(key)).alias("n"))
    folds = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo, hi = F.floor(F.col("n") * F.col("fold") / k), F.floor(F.col("n") * (F.col("fold") + 1) / k)
    role = (
        F.when((F.col("i") >= lo) & (F.col("i") < hi), "test").when((F.col("i") < lo) & (F.col("i") + horizon > lo), "purged")
        .when((F.col("i") >= hi) & (F.col("i") < hi + F.floor(F.col("n") * embargo)), "embargo").otherwise("train")
    )
    return folds.select(key, "date", "fold", role.alias("role"))


def dca(rows: DataFrame, key: str, order: str, ret: str, each: float, first: float) -> DataFrame:
    """key, order, paid, worth: v = (v + c)(1 + r) in closed form, v_t = G_t (first + sum of c / G before)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    g = rows.select(key, order, ret, F.exp(F.sum(F.ln(1 + F.col(ret))).over(w)).alias("g"))
    before = F.col("g") / (1 + F.col(ret))
    return g.select(key, order, (first + each * F.count("*").over(w)).alias("paid"), (F.col("g") * (first + F.sum(each / before).over(w))).alias("worth"))


def scenarios(rows: DataFrame, gross: Column, turnover: Column, bps: list[int]) -> DataFrame:
    """Each row once for each cost in basis points, with net: gross less twice the turnover's cost."""
    cases = F.explode(F.array(*[F.lit(b) for b in bps])).alias("bps")
    return rows.select("*", cases).withColumn("net", gross - turnover * 2 * F.col("bps") / 10000)


def selected(panel: DataFrame, by: str, score: str, n: int = 20, cap: float = 0.05, sector_cap: float = 0.30) -> DataFrame:
    """by, ticker, sector, weight: the best of each date, at most a sector's share of places, equal and capped weights."""
    places = max(1, int(sector_cap * n))
    w = Window.partitionBy(by, "sector").orderBy(F.desc(score), "ticker")
    fits = panel.withColumn("_s", F.row_number().over(w)).where(F.col("_s") <= places)
    top = fits.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "ticker"))).where(F.col("_k") <= n)
    weight = F.least(F.lit(cap), 1 / F.count("*").over(whole(by)))
    held = top.select(by, "ticker", "sector", weight.alias("weight"))
    return held.withColumn("weight", F.col("weight") / F.sum("weight").over(whole(by)))


def greedy(panel: DataFrame, by: str, n: int = 20, sector_cap: float = 0.30) -> DataFrame:
    """run, by, ticker, weight: names still among the best 2n stay first, then the best, under a sector cap.

    Each date depends on the one before, so a run's dates are folded in order, one at a
    time; candidates (2n a date) are chosen in Spark first. Columns run and n of the
    panel, where it has them, give several runs, which are dealt out over tasks.
    """
    rows = panel if "run" in panel.columns else panel.withColumns({"run": F.lit(0), "n": F.lit(n)})
    w = Window.partitionBy("run", by).orderBy(F.desc("score"), "ticker")
    few = rows.select("run", by, "ticker", "sector", "n", F.row_number().over(w).alias("k")).where(F.col("k") <= 2 * F.col("n"))
    kinds = {c: few.schema[c].dataType.simpleString() for c in ("run", by, "ticker")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, set()
        for (run, date), day, fields in days(batches, "run", by):
            if run != at:
                at, held = run, set()
            most = day["n"][0]
            places = max(1, int(sector_cap * most))
            room: dict = {}
            picked = []
            for _, _, ticker, sector in sorted((t not in held, k, t, s) for t, k, s in zip(day["ticker"], day["k"], day["sector"], strict=True)):
                if len(picked) < most and room.get(sector, 0) < places:
                    picked.append(ticker)
                    room[sector] = room.get(sector, 0) + 1
            held = set(picked)
            size = len(picked)
            date_type = fields.field(by).type
            dates = pa.array([date] * size, pa.int32()).cast(date_type) if pa.types.is_date(date_type) else pa.array([date] * size, date_type)
            yield pa.record_batch([pa.array([run] * size, fields.field("run").type), dates, pa.array(picked, fields.field("ticker").type), pa.array([1 / max(1, size)] * size, pa.float64())], ["run", by, "ticker", "weight"])

    return few.repartition("run").sortWithinPartitions("run", by, "k").mapInArrow(fold, f"run {kinds['run']}, {by} {kinds[by]}, ticker {kinds['ticker']}, weight double")


def bootstrap_sharpe(rows: DataFrame, key: str, ret: str, periods: float, draws: int = 500, seed: int = 42) -> DataFrame:
    """key, low, high: a seeded bootstrap's 95 % range of the annual ratio; a key is a series of a return a period."""

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        r = part.sort_values("date")[ret].to_numpy()
        rng = np.random.default_rng(seed)
        some = r[rng.integers(0, len(r), (draws, len(r)))]
        sd = some.std(axis=1)
        s = np.where(sd > 0, some.mean(axis=1) / np.where(sd > 0, sd, 1), 0) * periods**0.5
        low, high = np.percentile(s, [2.5, 97.5])
        return pd.DataFrame({key: [part[key].iloc[0]], "low": [low], "high": [high]})

    return rows.select(key, "date", ret).groupBy(key).applyInPandas(draw, f"{key} long, low double, high double")
