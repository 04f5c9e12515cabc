"""Learnt signals: regressions by aggregates, shape functions by binned means, drift and orthogonal scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import whole


def two_factor_ols(rows: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """by, n, ca, cb, c0, r2: least squares of y on a and b in each group, from one pass of moments."""
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.var_pop(y).alias("vy"),
        F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by"),
    )
    det = F.col("va") * F.col("vb") - F.col("ab") * F.col("ab")
    m = m.withColumns({"ca": ratio(F.col("vb") * F.col("ay") - F.col("ab") * F.col("by"), det), "cb": ratio(F.col("va") * F.col("by") - F.col("ab") * F.col("ay"), det)})
    return m.select(
        *by, "n", "ca", "cb", (F.col("my") - F.col("ca") * F.col("ma") - F.col("cb") * F.col("mb")).alias("c0"),
        ratio(F.col("ca") * F.col("ay") + F.col("cb") * F.col("by"), F.col("vy")).alias("r2"), "ma", "mb",
    )


def shape_functions(rows: DataFrame, y: str, features: list[str], bins: int = 20, rounds: int = 3) -> tuple[DataFrame, dict[str, list[float]]]:
    """rows with f_<x> for each feature and prediction; and the shapes, learnt by backfitting binned means.

    A shape is a mean residual in each of ``bins`` equal bins, smoothed over three neighbours and centred: a short
    array that travels as a literal. Each round is an aggregation of ``bins`` rows a feature.
    """
    ends = rows.agg(F.avg(y).alias("mean"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    mean = ends["mean"] or 0.0
    at = {c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(c) - (ends[f"lo_{c}"] or 0.0)) / max(1e-12, (ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0)) * bins))).cast("int") for c in features}
    shapes = {c: [0.0] * bins for c in features}

    def shape(c: str) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in shapes[c]]), at[c])

    for _ in range(rounds):
        for c in features:
            rest = F.col(y) - mean - sum((shape(o) for o in features if o != c), F.lit(0.0))
            found = rows.groupBy(at[c].alias("bin")).agg(F.avg(rest).alias("m"), F.count("*").alias("n")).toPandas()
            value, n = np.zeros(bins), np.zeros(bins)
            value[found["bin"]], n[found["bin"]] = found["m"], found["n"]
            smooth = np.convolve(np.pad(value * n, 1), [0.25, 0.5, 0.25], "valid") / np.maximum(1e-12, np.convolve(np.pad(n, 1), [0.25, 0.5, 0.25], "valid"))
            shapes[c] = (smooth - (smooth * n).sum() / max(1.0, n.sum())).tolist()
    out = rows.select("*", *[shape(c).alias(f"f_{c}") for c in features])
    return out.withColumn("prediction", mean + sum((F.col(f"f_{c}") for c in features), F.lit(0.0))), shapes


def ridge(rows: DataFrame, y: str, features: list[str], alpha: float = 0.0) -> tuple[dict[str, float], float]:
    """Weights of ``features`` and intercept of least squares for y with ``alpha`` times the squared weights added, from one aggregation of second moments.

    Rows with a null among the columns are left out. Where the moments have no inverse (a feature that
    is constant, or another's multiple) alpha is 1. No rows give 0s.
    """
    names = [*features, y]
    known = rows.na.drop(subset=names)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    told = known.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)], *[F.avg(c).alias(f"m{k}") for k, c in enumerate(names)]).first()
    cov = np.zeros((len(names), len(names)))
    for j, (a, b) in enumerate(pairs):
        cov[names.index(a), names.index(b)] = cov[names.index(b), names.index(a)] = (told[f"c{j}"] or 0.0) * told["n"]
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    if not alpha and np.linalg.matrix_rank(xx, hermitian=True) < len(features):
        alpha = 1.0
    weights = np.linalg.solve(xx + alpha * np.eye(len(features)), xy) if features else np.zeros(0)
    means = np.array([told[f"m{k}"] or 0.0 for k in range(len(names))], float)
    return dict(zip(features, weights.tolist(), strict=True)), float(means[-1] - weights @ means[:-1])


def residual_alpha(rows: DataFrame, y: str, factors: list[str], features: list[str], alpha: float = 1.0, train: Column | None = None, **trees) -> tuple[DataFrame, dict]:
    """rows with linear, residual_alpha and total; and weights, intercept, linear_r2, residual_r2 and overlap.

    The first stage explains y by ``factors`` (ridge), the second what that leaves by boosted trees over
    ``features``; both learn from rows where ``train`` holds. ``overlap`` is the size of the correlation of the two
    stages' predictions over those rows. Null factors give a null linear score; rows with a null y take no part in learning.
    """
    from tidemark.operators import boosting

    learnt = rows if train is None else rows.where(train)
    weights, intercept = ridge(learnt, y, factors, alpha)
    linear = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(intercept))
    model = boosting.fit(learnt.withColumn("_rest", F.col(y) - linear), "_rest", features, **trees)
    out = boosting.predicted(rows.withColumn("linear", linear), model, "residual_alpha").withColumn("total", F.col("linear") + F.col("residual_alpha"))
    told = (out if train is None else out.where(train)).na.drop(subset=[y, "linear"])
    rest, left = F.col(y) - F.col("linear"), F.col(y) - F.col("total")
    r = told.agg(
        (1 - ratio(F.avg(rest * rest), F.var_pop(y))).alias("linear_r2"), (1 - ratio(F.avg(left * left), F.var_pop(rest))).alias("residual_r2"),
        F.stddev_pop("linear").alias("s1"), F.stddev_pop("residual_alpha").alias("s2"), F.corr("linear", "residual_alpha").alias("overlap"),
    ).first()
    flat = min(r["s1"] or 0.0, r["s2"] or 0.0) < 1e-10
    return out, {"weights": weights, "intercept": intercept, "linear_r2": r["linear_r2"], "residual_r2": r["residual_r2"], "overlap": 0.0 if flat else abs(r["overlap"])}


def orthogonalised(rows: DataFrame, y: str, features: list[str], factors: list[str], most: float = 0.05, steps: int = 1000, rate: float = 0.1) -> tuple[DataFrame, dict]:
    """rows with alpha, a linear score of ``features`` for ``y`` whose correlation with each factor is below ``most``; and its weights and how it was found.

    All sums that the steps need are second moments of the table: one aggregation of some
    k^2 numbers. From the least-squares weights on what the factors leave of y, each step
    moves against the correlations that are too large; where steps don't end below
    ``most`` the weights are projected off the factors. Rows with a null among the columns
    are left out of the sums and get a null alpha; no rows, or features without variance,
    give weights of 0.
    """
    names = [*features, *factors, y]
    known = rows.na.drop(subset=names)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    told = known.agg(*[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)], *[F.avg(c).alias(f"m{k}") for k, c in enumerate(names)]).first()
    n, k = len(features), len(factors)
    cov = np.zeros((len(names), len(names)))
    for j, (a, b) in enumerate(pairs):
        cov[names.index(a), names.index(b)] = cov[names.index(b), names.index(a)] = told[f"c{j}"] or 0.0
    scale = np.where(np.diag(cov) > 1e-24, np.sqrt(np.maximum(np.diag(cov), 1e-24)), 1.0)
    own = cov / np.outer(scale, scale)  # correlations: steps don't depend on units
    xx, xf, ff = own[:n, :n], own[:n, n : n + k], own[n : n + k, n : n + k]
    target = own[:n, -1] - xf @ np.linalg.pinv(ff) @ own[n : n + k, -1]
    weights = np.linalg.pinv(xx) @ target

    def correlations(w: np.ndarray) -> np.ndarray:
        size = float(w @ xx @ w)
        return (xf.T @ w) / np.sqrt(size * np.maximum(np.diag(ff), 1e-12)) if size > 1e-12 else np.zeros(k)

    taken, fallback = 0, False
    while np.abs(found := correlations(weights)).max(initial=0.0) >= most:
        if taken == steps:
            fallback = True
            weights = weights - np.linalg.pinv(xf.T) @ (xf.T @ weights)
            break
        size = np.sqrt(float(weights @ xx @ weights))
        push = np.where(np.abs(found) >= most, found, 0.0)
        slope = (xf @ push - (push @ found) * (xx @ weights) / size) / size  # of half the squares of the correlations
        weights = weights - rate * size * size * slope
        taken += 1
    weights = weights / scale[:n] * scale[-1]
    alpha = sum((F.lit(float(w)) * (F.col(c) - F.lit(float(told[f"m{j}"] or 0.0))) for j, (w, c) in enumerate(zip(weights, features, strict=True))), F.lit(0.0))
    return rows.withColumn("alpha", alpha), {"weights": dict(zip(features, weights.tolist(), strict=True)), "steps": taken, "fallback": fallback}


def drift(rows: DataFrame, value: str, window: int = 20, bins: int = 10, most: float = 0.1) -> DataFrame:
    """ticker, kl, drifted: divergence of the newer half of the last values from the older, over equal bins of their range."""
    from pyspark.sql import Window

    last = rows.select("ticker", F.col(value).alias("v"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("k")).where(F.col("k") <= window)
    w = whole("ticker")
    width = F.max("v").over(w) - F.min("v").over(w)
    binned = last.select("ticker", (F.col("k") <= window // 2).alias("newer"), F.least(F.lit(bins - 1), F.floor(F.coalesce(ratio((F.col("v") - F.min("v").over(w)) * bins, width), F.lit(0.0)))).alias("bin"))
    shares = binned.groupBy("ticker", "bin").agg(F.count_if("newer").alias("new"), F.count_if(~F.col("newer")).alias("old"))
    p, q = (F.col("new") + 0.01) / (window / 2 + 0.1), (F.col("old") + 0.01) / (window / 2 + 0.1)
    empty = F.lit(0.01 / (window / 2 + 0.1))  # bins without values add p ln 1 = 0
    out = shares.groupBy("ticker").agg(F.sum(p * F.ln(p / q)).alias("kl"), (F.lit(bins) - F.count("*")).alias("rest"))
    return out.select("ticker", (F.col("kl") + 0 * empty * F.col("rest")).alias("kl"), (F.col("kl") > most).alias("drifted"))
