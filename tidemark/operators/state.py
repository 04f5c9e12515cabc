"""Recursive state over a ticker's ordered values, folded inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(rows: DataFrame, value: str) -> DataFrame:
    """ticker and its values in order of date: a series is a bounded array (a value a day)."""
    return rows.groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v")))), lambda x: x["v"]).alias("v"))


def ewm_std(rows: DataFrame, value: str, span: int) -> DataFrame:
    """ticker, ewm_std: exponentially weighted spread with adjusted weights and the bias taken out."""
    keep = 1 - 2 / (span + 1)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("sw", "sw2", "m", "s")])

    def step(a: Column, v: Column) -> Column:
        sw = a["sw"] * keep + 1
        m = a["m"] + (v - a["m"]) / sw
        return F.struct(sw.alias("sw"), (a["sw2"] * keep**2 + 1).alias("sw2"), m.alias("m"), (a["s"] * keep + (v - a["m"]) * (v - m)).alias("s"))

    last = F.aggregate("v", zero, step)
    out = _ordered(rows, value).select("ticker", last.alias("a"))
    spread = F.col("a.sw") * F.col("a.sw")
    return out.select("ticker", F.sqrt(F.col("a.s") / F.col("a.sw") * F.try_divide(spread, spread - F.col("a.sw2"))).alias("ewm_std"))


def ema(rows: DataFrame, value: str, weight: float) -> DataFrame:
    """ticker, ema: (1 - weight) of the mean so far and weight of the new value, from the first value on."""
    return _ordered(rows, value).select("ticker", F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", 0), lambda a, v: (1 - weight) * a + weight * v).alias("ema"))


def online_regime(rows: DataFrame, value: str, decay: float = 0.97) -> DataFrame:
    """ticker, bull, mean_bull, mean_bear: two Gaussian states whose means and variances follow each value by its share."""
    start = F.struct(F.lit(0.001).alias("m1"), F.lit(0.0004).alias("v1"), F.lit(-0.001).alias("m2"), F.lit(0.0009).alias("v2"), F.lit(0.5).alias("p"))

    def density(v: Column, m: Column, var: Column) -> Column:
        return F.exp(-(v - m) * (v - m) / (2 * var)) / F.sqrt(2 * 3.141592653589793 * var)

    def step(a: Column, v: Column) -> Column:
        one, two = a["p"] * density(v, a["m1"], a["v1"]), (1 - a["p"]) * density(v, a["m2"], a["v2"])
        p = F.coalesce(F.try_divide(one, one + two), a["p"])
        p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), 0.9 * p + 0.05))
        r1, r2 = (1 - decay) * p, (1 - decay) * (1 - p)
        m1, m2 = a["m1"] + r1 * (v - a["m1"]), a["m2"] + r2 * (v - a["m2"])
        return F.struct(
            m1.alias("m1"), F.greatest((1 - r1) * a["v1"] + r1 * (v - m1) * (v - m1), F.lit(1e-8)).alias("v1"),
            m2.alias("m2"), F.greatest((1 - r2) * a["v2"] + r2 * (v - m2) * (v - m2), F.lit(1e-8)).alias("v2"), p.alias("p"),
        )

    return _ordered(rows, value).select("ticker", F.aggregate("v", start, step).alias("a")).select("ticker", F.col("a.p").alias("bull"), F.col("a.m1").alias("mean_bull"), F.col("a.m2").alias("mean_bear"))
