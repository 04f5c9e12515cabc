"""Risk and execution as expressions and joins; optimisers on a matrix of a bounded universe."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import norm_cdf, ratio
from tidemark.functions.windows import whole

#: Shares of a day's volume in its 13 half hours.
PROFILE = (0.15, 0.10, 0.08, 0.06, 0.05, 0.05, 0.05, 0.05, 0.06, 0.07, 0.08, 0.09, 0.11)


def component_var(weights: DataFrame, cov: DataFrame, z: float = 1.6448536269514722) -> DataFrame:
    """ticker, marginal, component, share of a portfolio's value at risk; cov: t1 <= t2."""
    full = cov.select("t1", "t2", "cov").union(cov.where("t1 < t2").select(F.col("t2"), F.col("t1"), "cov"))
    other = weights.select(F.col("ticker").alias("t2"), F.col("weight").alias("w2"))
    sw = full.join(other, "t2").groupBy(F.col("t1").alias("ticker")).agg(F.sum(F.col("cov") * F.col("w2")).alias("sw"))
    rows = weights.join(sw, "ticker")
    total = rows.agg(F.sqrt(F.sum(F.col("weight") * F.col("sw"))).alias("sigma"))
    out = rows.join(F.broadcast(total)).withColumn("marginal", z * F.col("sw") / F.col("sigma"))
    component = F.col("weight") * F.col("marginal")
    return out.select("ticker", "marginal", component.alias("component"), (component / (z * F.col("sigma"))).alias("share"))


def put_price(spot: Column, strike: Column, years: Column, rate: float, vol: Column) -> Column:
    """Black-Scholes value of a put."""
    d1 = (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / (vol * F.sqrt(years))
    d2 = d1 - vol * F.sqrt(years)
    return strike * F.exp(-rate * years) * norm_cdf(-d2) - spot * norm_cdf(-d1)


def hedge_ratio(beta: Column) -> Column:
    """The share to hedge at a portfolio's beta."""
    return F.when(beta > 1.2, 1.0).when(beta > 0.8, 0.5).otherwise(0.0)


def vwap_schedule(orders: DataFrame) -> DataFrame:
    """ticker, bin, shares: an order (ticker, quantity) over the day's profile; rounding's rest goes to the last bin."""
    total = sum(PROFILE)
    bins = orders.select("ticker", "quantity", F.posexplode(F.array(*[F.lit(p / total) for p in PROFILE])).alias("bin", "part"))
    w = Window.partitionBy("ticker").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("shares", F.round(F.col("quantity") * F.col("part")).cast("long"))
    last = F.col("quantity").cast("long") - F.coalesce(F.sum("shares").over(w), F.lit(0))
    return bins.select("ticker", "bin", F.when(F.col("bin") == len(PROFILE) - 1, last).otherwise(F.col("shares")).alias("shares"))


def impact_bps(vol: Column, quantity: Column, adv: Column) -> Column:
    """Square-root impact in basis points."""
    return vol * F.sqrt(ratio(quantity, adv)) * 10_000


def slipped(price: Column, side: Column, quantity: Column, volume: Column, bps: float = 5.0, factor: float = 0.1) -> tuple[Column, Column]:
    """A price slipped by fixed basis points, and by the square root of the share of volume; side is 1 or -1."""
    return price * (1 + side * bps / 10_000), price * (1 + side * factor * F.sqrt(F.least(F.lit(1.0), F.coalesce(ratio(quantity, volume), F.lit(1.0)))))


def constraint_checks(weights: DataFrame, most: float, sector_most: float, betas: tuple[float, float]) -> DataFrame:
    """rule, passed, worst, violators of a portfolio (ticker, sector, weight, beta)."""
    each = weights.agg(F.max("weight").alias("worst"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("weight") > most, F.col("ticker")))).cast("array<string>"), ",").alias("violators"))
    by_sector = weights.groupBy("sector").agg(F.sum("weight").alias("w"))
    sector = by_sector.agg(F.max("w").alias("worst"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("w") > sector_most, F.col("sector")))), ",").alias("violators"))
    beta = weights.agg(F.sum(F.col("weight") * F.col("beta")).alias("worst"), F.lit("").alias("violators"))
    out = each.select(F.lit("max_weight").alias("rule"), (F.col("worst") <= most).alias("passed"), "worst", "violators")
    out = out.union(sector.select(F.lit("sector"), F.col("worst") <= sector_most, "worst", "violators"))
    return out.union(beta.select(F.lit("beta"), F.col("worst").between(*betas), "worst", "violators"))


def look_through(held: DataFrame, parts: DataFrame) -> DataFrame:
    """holder, asset, weight: holdings (holder, fund, weight) dissolved into their funds' parts (fund, asset, share, 0-1 or 0-100)."""
    total = F.sum("share").over(whole("fund"))
    scaled = parts.select("fund", "asset", F.when(total > 1.5, F.col("share") / 100).otherwise(F.col("share")).alias("share"))
    return held.join(scaled, "fund").groupBy("holder", "asset").agg(F.sum(F.col("weight") * F.col("share")).alias("weight"))


def linked(dist: np.ndarray, linkage: str = "single") -> list[int]:
    """The leaves of a tree of distances in order: the nearest two groups join, ``single`` by their nearest members, ``ward`` by the growth of their spread."""
    n = len(dist)
    d = np.full((max(0, 2 * n - 1),) * 2, np.inf)
    d[:n, :n] = dist
    np.fill_diagonal(d, np.inf)
    leaves, live = {k: [k] for k in range(n)}, list(range(n))
    for new in range(n, 2 * n - 1):
        part = d[np.ix_(live, live)]
        a, b = sorted((live[k] for k in np.unravel_index(int(part.argmin()), part.shape)))
        na, nb, rest = len(leaves[a]), len(leaves[b]), [k for k in live if k not in (a, b)]
        for k in rest:
            if linkage == "ward":
                nk = len(leaves[k])
                held = np.sqrt(((na + nk) * d[a, k] ** 2 + (nb + nk) * d[b, k] ** 2 - nk * d[a, b] ** 2) / (na + nb + nk))
            else:
                held = min(d[a, k], d[b, k])
            d[new, k] = d[k, new] = held
        leaves[new] = leaves[a] + leaves[b]
        live = [*rest, new]
    return leaves[live[0]] if live else []


def hierarchical(cov: np.ndarray, linkage: str = "single") -> np.ndarray:
    """Hierarchical risk parity: leaves of the correlations' tree in order, halves by inverse variance."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    dist = np.sqrt(np.maximum(0, (1 - np.clip(cov / np.outer(sd, sd), -1, 1)) / 2))
    w = np.ones(len(cov))

    def spread(part: list) -> float:
        inverse = 1 / np.maximum(np.diag(cov)[part], 1e-16)
        inverse /= inverse.sum()
        return float(inverse @ cov[np.ix_(part, part)] @ inverse)

    stack = [linked(dist, linkage)]
    while stack:
        part = stack.pop()
        if len(part) > 1:
            a, b = part[: len(part) // 2], part[len(part) // 2 :]
            va, vb = spread(a), spread(b)
            w[a] *= vb / (va + vb)
            w[b] *= va / (va + vb)
            stack += [a, b]
    return w


def on_simplex(v: np.ndarray, cap: float, total: float = 1.0) -> np.ndarray:
    """The nearest point with sum ``total`` and parts between 0 and cap (raised to what the sum needs).

    The sum falls in straight pieces as all parts are shifted down: the piece that
    reaches the total gives the shift.
    """
    cap = max(cap, total / len(v))
    shifts = np.unique(np.concatenate([v, v - cap]))
    sums = np.clip(v[None, :] - shifts[:, None], 0, cap).sum(axis=1)
    shift = np.interp(total, sums[::-1], shifts[::-1])
    return np.clip(v - shift, 0, cap)


def _climbed(mu: np.ndarray, cov: np.ndarray, project, start: np.ndarray, steps: int) -> np.ndarray:
    """The best w'mu - w'Cw/2 of a convex set by accelerated projected gradients, begun anew whenever a step leads back."""
    rate = 1 / max(1e-12, np.linalg.eigvalsh(cov)[-1])
    w = at = start
    pace = 1.0
    for _ in range(steps):
        new = project(at + rate * (mu - cov @ at))
        if (at - new) @ (new - w) > 0:
            at, pace = w, 1.0
            new = project(at + rate * (mu - cov @ at))
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        at = new + (pace - 1) / after * (new - w)
        moved, w, pace = np.abs(new - w).max(), new, after
        if moved < 1e-12:
            break
    return w


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, cap: float = 0.2, steps: int = 5000) -> np.ndarray:
    """Weights that make w'mu - aversion/2 w'Cw greatest, sum 1, each between 0 and cap (or an equal share, if that is more)."""
    return _climbed(mu, aversion * cov, lambda v: on_simplex(v, cap), np.full(len(mu), 1 / len(mu)), steps)


def kelly(mu: np.ndarray, cov: np.ndarray, most: float = 1.0, half: float = 0.5, steps: int = 5000) -> np.ndarray:
    """A share of the long-only weights of greatest growth w'mu - w'Cw/2 with a sum of at most ``most``."""

    def project(v: np.ndarray) -> np.ndarray:
        held = np.maximum(0, v)
        return held if held.sum() <= most else on_simplex(v, most, most)

    return half * _climbed(mu, cov, project, np.zeros(len(mu)), steps)


def black_litterman(cov: np.ndarray, market: np.ndarray, z: np.ndarray, aversion: float = 2.5, tau: float = 0.05, ic: float = 0.05) -> np.ndarray:
    """Long-only weights of the posterior mean: equilibrium returns, and views ic sigma z on each name."""
    equilibrium = aversion * cov @ market
    views, doubt = ic * np.sqrt(np.diag(cov)) * z, np.diag(np.maximum(np.diag(tau * cov), 1e-12))
    a = np.linalg.inv(tau * cov + 1e-10 * np.eye(len(z)))
    b = np.linalg.inv(doubt)
    mean = np.linalg.solve(a + b, a @ equilibrium + b @ views)
    w = np.maximum(0, np.linalg.solve(aversion * cov + 1e-10 * np.eye(len(z)), mean))
    return w / w.sum() if w.sum() > 0 else np.full(len(z), 1 / len(z))
