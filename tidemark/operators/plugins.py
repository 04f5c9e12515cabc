"""What users add by name: factors, optimisers and risk checks, and the configurations that call for them.

A registry holds classes or functions under names with their parameters. A configuration
is a table of names and parameters; what it names and nobody has registered becomes a
row, not an error.
"""

from __future__ import annotations

import importlib
import inspect
import json
import pkgutil
from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import Rolling
from tidemark.operators import factors as A
from tidemark.operators import portfolio as P


@runtime_checkable
class Optimiser(Protocol):
    """Weights of names from their scores, yearly covariances and market caps; None where it can't. ``otherwise`` names what is tried then."""

    otherwise: str

    def optimise(self, score: np.ndarray, cov: np.ndarray, caps: np.ndarray) -> np.ndarray | None: ...


@runtime_checkable
class RiskCheck(Protocol):
    """passed, worst and violators of every portfolio (as_of, ticker, sector, beta, weight), one row an as_of."""

    def check(self, weights: DataFrame) -> DataFrame: ...


class Registry:
    """Names and what makes them; ``kind`` is what everything in it must be an instance of, or None for functions."""

    def __init__(self, name: str, kind: type | None = None) -> None:
        self.name, self.kind = name, kind
        self.made: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable[[Any], Any]:
        """A decorator; a name is given once."""

        def held(make: Any) -> Any:
            if name in self.made:
                raise ValueError(f"{self.name} {name} is registered already")
            if self.kind is not None and not all(hasattr(make, m) for m in vars(self.kind) if not m.startswith("_") and callable(getattr(self.kind, m))):
                raise TypeError(f"{make.__name__} is no {self.kind.__name__}")
            self.made[name] = make
            return make

        return held

    def get(self, name: str, **params: Any) -> Any:
        """What the name makes with its parameters; a KeyError tells the names there are."""
        if name not in self.made:
            raise KeyError(f"no {self.name} {name}; there are {', '.join(sorted(self.made))}")
        return self.made[name](**params)

    def __contains__(self, name: str) -> bool:
        return name in self.made

    def accepts(self, name: str) -> list[str]:
        """The parameters that a name takes."""
        return list(inspect.signature(self.made[name]).parameters)

    def discover(self, package: str) -> list[str]:
        """Import every module of a package, so that its decorators run; the names that this added."""
        before = set(self.made)
        home = importlib.import_module(package)
        for found in pkgutil.iter_modules(getattr(home, "__path__", [])):
            importlib.import_module(f"{package}.{found.name}")
        return sorted(set(self.made) - before)


FACTORS = Registry("factor")
OPTIMISERS = Registry("optimiser", Optimiser)
RISKS = Registry("risk check", RiskCheck)
KINDS = {"factor": FACTORS, "optimiser": OPTIMISERS, "risk": RISKS}


for _name, _make in (
    ("high_52w", A.high_momentum), ("momentum_12m", A.momentum_12m), ("momentum_6m", A.momentum_6m), ("momentum_12_1", A.momentum_difference), ("vsm", A.vol_scaled_total),
    ("vsm_classic", A.vol_scaled_momentum), ("vsm_target", A.vol_targeted_momentum), ("bab", A.betting_against_beta), ("ivol", A.idiosyncratic_vol), ("volatility_60d", A.volatility_60d),
    ("amihud", A.amihud), ("levy", A.levy),
):
    FACTORS.register(_name)(_make)


@OPTIMISERS.register("hrp")
class HierarchicalParity:
    """Risk parity over a tree of correlations."""

    otherwise = "mvo"

    def __init__(self, linkage: str = "ward") -> None:
        self.linkage = linkage

    def optimise(self, score: np.ndarray, cov: np.ndarray, caps: np.ndarray) -> np.ndarray | None:
        if not (np.diag(cov) > 0).any():
            return None
        weights = P.hierarchical(cov, self.linkage)
        return weights / weights.sum()


@OPTIMISERS.register("bl")
class BlackLitterman:
    """Views ic sigma z of each name on the market's equilibrium; five market caps at least."""

    otherwise = "hrp"

    def __init__(self, tau: float = 0.05, aversion: float = 2.5, ic: float = 0.05) -> None:
        self.tau, self.aversion, self.ic = tau, aversion, ic

    def optimise(self, score: np.ndarray, cov: np.ndarray, caps: np.ndarray) -> np.ndarray | None:
        known = np.isfinite(caps) & (caps > 0) & (np.diag(cov) > 0)
        if known.sum() < 5:
            return None
        out = np.zeros(len(score))
        some = np.ix_(known, known)
        out[known] = P.black_litterman(cov[some], caps[known] / caps[known].sum(), score[known], self.aversion, self.tau, self.ic)
        return out


@OPTIMISERS.register("kelly")
class Kelly:
    """A share of the weights of greatest growth; expected returns are 5 % a unit of score."""

    otherwise = "mvo"

    def __init__(self, share: float = 0.5, most: float = 1.0, each: float = 0.05) -> None:
        self.share, self.most, self.each = share, most, each

    def optimise(self, score: np.ndarray, cov: np.ndarray, caps: np.ndarray) -> np.ndarray | None:
        return P.kelly(score * self.each, cov, self.most, self.share)


@OPTIMISERS.register("mvo")
class MeanVariance:
    """Mean and variance under a cap; expected returns are 0.05 % a unit of score."""

    otherwise = "equal"

    def __init__(self, aversion: float = 1.0, cap: float = 0.1, each: float = 0.0005) -> None:
        self.aversion, self.cap, self.each = aversion, cap, each

    def optimise(self, score: np.ndarray, cov: np.ndarray, caps: np.ndarray) -> np.ndarray | None:
        return P.mean_variance(score * self.each, cov, self.aversion, self.cap)


@RISKS.register("max_weight")
class MaxWeight:
    """No name above a weight."""

    def __init__(self, most: float = 0.1) -> None:
        self.most = most

    def check(self, weights: DataFrame) -> DataFrame:
        over = F.sort_array(F.collect_list(F.when(F.col("weight") > self.most + 1e-9, F.col("ticker").cast("string"))))
        return weights.groupBy("as_of").agg((F.max("weight") <= self.most + 1e-9).alias("passed"), F.max("weight").alias("worst"), F.array_join(over, ",").alias("violators"))


@RISKS.register("sector")
class SectorWeight:
    """No sector above a weight; names without one are a sector of their own."""

    def __init__(self, most: float = 0.3) -> None:
        self.most = most

    def check(self, weights: DataFrame) -> DataFrame:
        each = weights.groupBy("as_of", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("w"))
        over = F.sort_array(F.collect_list(F.when(F.col("w") > self.most + 1e-9, F.col("sector"))))
        return each.groupBy("as_of").agg((F.max("w") <= self.most + 1e-9).alias("passed"), F.max("w").alias("worst"), F.array_join(over, ",").alias("violators"))


@RISKS.register("beta")
class BetaBand:
    """The book's beta within a band; a name without one counts as 1."""

    def __init__(self, least: float = 0.8, most: float = 1.2) -> None:
        self.least, self.most = least, most

    def check(self, weights: DataFrame) -> DataFrame:
        beta = F.sum(F.col("weight") * F.coalesce("beta", F.lit(1.0)))
        return weights.groupBy("as_of").agg(beta.between(self.least, self.most).alias("passed"), beta.alias("worst"), F.lit("").alias("violators"))


#: Default configuration: what is switched on, by kind, with parameters as JSON, and a factor's weight in the blend.
CONFIG = "kind string, name string, params string, weight double, enabled boolean"


def resolved(config: list[tuple]) -> Iterator[tuple[tuple, Any, str]]:
    """Each row of a configuration with what it makes, or None and why not: an unknown kind, name or parameter, bad JSON, or switched off."""
    for row in config:
        kind, name, params, _, enabled = row
        if enabled is False:
            yield row, None, "disabled"
            continue
        if kind not in KINDS:
            yield row, None, "unknown kind"
            continue
        if name not in KINDS[kind]:
            yield row, None, "unknown name"
            continue
        try:
            held = json.loads(params or "{}")
        except ValueError:
            held = None
        if not isinstance(held, dict):
            yield row, None, "params are no JSON object"
            continue
        unknown = sorted(set(held) - set(KINDS[kind].accepts(name)))
        yield (row, None, f"unknown parameter {unknown[0]}") if unknown else (row, KINDS[kind].get(name, **held), "ok")


def told(spark: SparkSession, config: list[tuple]) -> DataFrame:
    """kind, name, weight and status of each row of a configuration; a null weight counts as 1."""
    return spark.createDataFrame([(r[0], r[1], 1.0 if r[3] is None else float(r[3]), why) for r, _, why in resolved(config)], "kind string, name string, weight double, status string")


def factors(config: list[tuple], at: Rolling | None = None) -> dict[str, tuple[float, Column]]:
    """The weight and column, f_<name>, of each factor that a configuration switches on; a null weight counts as 1. ``at``: how factors that can choose read a ticker's rows."""
    found = {}
    for row, f, _ in resolved(config):
        if f is not None and row[0] == "factor":
            if at is not None and "at" in FACTORS.accepts(row[1]):
                f = FACTORS.get(row[1], **{**json.loads(row[2] or "{}"), "at": at})
            found[f"f_{row[1]}"] = (1.0 if row[3] is None else float(row[3]), f)
    return found


def blended(rows: DataFrame, config: list[tuple], by: str, z: Callable[[str, str], Column]) -> DataFrame:
    """rows, which have the columns of :func:`factors`, with score: the weighted mean of their z-scores within ``by``, over the factors a row has; null without any."""
    parts = [(F.when(F.col(n).isNotNull(), z(n, by)), w) for n, (w, _) in factors(config).items()]
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return rows.withColumn("score", F.when(weight > 0, total / weight))


def risks(weights: DataFrame, config: list[tuple]) -> DataFrame | None:
    """as_of, rule, passed, worst, violators of every risk check that a configuration switches on."""
    out = None
    for row, made, _ in resolved(config):
        if made is None or row[0] != "risk":
            continue
        part = made.check(weights).select("as_of", F.lit(row[1]).alias("rule"), "passed", "worst", "violators")
        out = part if out is None else out.union(part)
    return out
