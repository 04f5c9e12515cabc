"""Two hidden Gaussian regimes of a ticker: fitted, decoded to their most probable path, and told by day."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that a fit needs, rounds of it, and the gain in log-likelihood below which it ends.
LEAST = 50
ROUNDS = 100
GAIN = 1e-2
#: What a regime leaves of the risk budget.
MULTIPLIERS = {"Bull": 1.0, "Bear": 0.5, "Unknown": 0.75}


#: Series of one length that are fitted side by side: some MB of states by day.
TOGETHER = 512


class Chain(NamedTuple):
    """Shares at the start, moves from row to column, means and variances of the states; and the rounds taken.

    Chains of many series have one more axis in front of each.
    """

    start: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    rounds: int | np.ndarray = 0

    def bull(self) -> np.ndarray:
        """The state of the greater mean less half its variance."""
        return np.argmax(self.mean - self.var / 2, axis=-1)

    def at(self, k: int | np.ndarray | slice | None) -> Chain:
        """The chains of some series; None adds an axis in front."""
        return Chain(*(np.asarray(x)[k] for x in self))


def _logs(x: np.ndarray, chain: Chain) -> np.ndarray:
    """Log-densities by day, series and state."""
    return -((x.T[:, :, None] - chain.mean) ** 2) / (2 * chain.var) - np.log(2 * np.pi * chain.var) / 2


def _smoothed(x: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`smoothed` for many series, a row each; probabilities by day, series and state."""
    logs = _logs(x, chain)
    top = logs.max(axis=2)
    dens = np.exp(logs - top[:, :, None])
    n = len(dens)
    fwd, back, scale = np.zeros_like(dens), np.ones_like(dens), np.zeros(dens.shape[:2])
    at, moves = chain.start, chain.moves
    for t in range(n):
        at = dens[t] * (at if t == 0 else at[:, :1] * moves[:, 0] + at[:, 1:] * moves[:, 1])
        scale[t] = at.sum(axis=1)
        fwd[t] = at = at / scale[t][:, None]
    for t in range(n - 2, -1, -1):
        then = dens[t + 1] * back[t + 1]
        back[t] = (moves[:, :, 0] * then[:, :1] + moves[:, :, 1] * then[:, 1:]) / scale[t + 1][:, None]
    post = fwd * back
    post /= post.sum(axis=2, keepdims=True)
    moved = np.einsum("tmi,tmj->mij", fwd[:-1], dens[1:] * back[1:] / scale[1:, :, None]) * moves
    return post, moved, np.log(scale).sum(axis=0) + top.sum(axis=0)


def smoothed(x: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, float]:
    """The states' probabilities by day given all values, the moves expected between them, and the log-likelihood."""
    post, moves, told = _smoothed(x[None], chain.at(None))
    return post[:, 0], moves[0], float(told[0])


def _fitted(x: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """:func:`fitted` for many series of one length, a row each; those that no longer gain are left as they are."""
    low = x <= np.median(x, axis=1, keepdims=True)
    high = np.where((~low).any(axis=1, keepdims=True), ~low, low)
    mean = np.stack([np.where(s, x, 0.0).sum(axis=1) / s.sum(axis=1) for s in (low, high)], axis=1)
    var = np.stack([np.where(s, (x - mean[:, k : k + 1]) ** 2, 0.0).sum(axis=1) / s.sum(axis=1) for k, s in enumerate((low, high))], axis=1)
    m = len(x)
    out = Chain(np.full((m, 2), 0.5), np.tile([[0.9, 0.1], [0.1, 0.9]], (m, 1, 1)), mean, np.maximum(1e-8, var), np.zeros(m, int))
    before, going = np.full(m, -np.inf), np.arange(m)
    for k in range(rounds):
        post, moves, told = _smoothed(x[going], out.at(going))
        moves = moves + 1e-12
        share = post.sum(axis=0) + 1e-12
        values = x[going].T[:, :, None]
        mean = (post * values).sum(axis=0) / share
        var = np.maximum(1e-8, (post * (values - mean) ** 2).sum(axis=0) / share)
        for held, new in zip(out, (post[0], moves / moves.sum(axis=2, keepdims=True), mean, var, k + 1), strict=True):
            held[going] = new
        gains = told - before[going] >= GAIN
        before[going] = told
        going = going[gains]
        if not len(going):
            break
    return out


def fitted(x: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """A chain for the values by expectation and maximisation, begun from a split at the median."""
    return _fitted(x[None], rounds).at(0)


def _decoded(x: np.ndarray, chain: Chain) -> np.ndarray:
    """:func:`decoded` for many series, a row each."""
    logs = _logs(x, chain)
    with np.errstate(divide="ignore"):
        moves, best = np.log(chain.moves), np.log(chain.start) + logs[0]
    came = np.zeros(logs.shape, int)
    for t in range(1, len(logs)):
        ways = best[:, :, None] + moves
        came[t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + logs[t]
    path, own = np.zeros(logs.shape[:2], int), np.arange(len(x))
    path[-1] = best.argmax(axis=1)
    for t in range(len(logs) - 1, 0, -1):
        path[t - 1] = came[t, own, path[t]]
    return path.T


def decoded(x: np.ndarray, chain: Chain) -> np.ndarray:
    """The most probable path of states; of equals the one of lower states, from the end."""
    return _decoded(x[None], chain.at(None))[0]


def regime_paths(rows: DataFrame, ret: str, last: int = 252, least: int = LEAST) -> DataFrame:
    """ticker, date, regime, bull, mean_bull, mean_bear, multiplier of each of a ticker's ``last`` returns.

    A ticker is a row with its last returns at most; tickers with as many are fitted side by side. Nulls and what
    is not finite are left out; with fewer than ``least`` values left the regime is Unknown, at even odds.
    """
    value = F.col(ret).cast("double")
    known = rows.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select("ticker", "date", value.alias("x"))
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    kind = rows.schema["ticker"].dataType.simpleString()
    names = np.array(["Bear", "Bull", "Unknown"])
    risk = np.array([MULTIPLIERS[r] for r in names])

    def tell(tickers: pa.Array, dates: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        m, n = x.shape
        kinds, bull, ends = np.full((m, n), 2), np.full((m, n), 0.5), None
        if n >= least:
            chain = _fitted(x)
            good, own = chain.bull(), np.arange(m)
            kinds = (_decoded(x, chain) == good[:, None]).astype(int)
            bull = _smoothed(x, chain)[0][:, own, good].T
            ends = (chain.mean[own, good], chain.mean[own, 1 - good])
        means = [pa.nulls(m * n, pa.float64()) if ends is None else pa.array(np.repeat(e, n)) for e in ends or (None, None)]
        columns = [tickers.take(pa.array(np.repeat(np.arange(m), n))), dates, pa.array(names[kinds.ravel()].tolist()), pa.array(bull.ravel()), *means, pa.array(risk[kinds.ravel()])]
        return pa.record_batch(columns, ["ticker", "date", "regime", "bull", "mean_bull", "mean_bear", "multiplier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("n").to_numpy()
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                for k in range(0, len(of), TOGETHER):
                    some = batch.take(pa.array(of[k : k + TOGETHER]))
                    yield tell(some.column("ticker"), some.column("dates").flatten(), some.column("xs").flatten().to_numpy().reshape(-1, int(n)))

    few = known.withColumn("_k", newest).where(F.col("_k") <= last).drop("_k")
    own = few.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "x"))).alias("r"))
    own = own.select("ticker", F.size("r").alias("n"), F.col("r.date").alias("dates"), F.col("r.x").alias("xs"))
    return own.mapInArrow(run, f"ticker {kind}, date date, regime string, bull double, mean_bull double, mean_bear double, multiplier double")
