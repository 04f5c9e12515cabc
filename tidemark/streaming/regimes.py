"""Regimes learnt from a stream: each ticker's state lives in the stream's state store and outlasts restarts.

The update is that of the batch fold in ``operators.state``. On top of it, where asked
for, errors of the last values are watched: when their newer half drifts from the older
one, learning is faster for a while.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where a ticker begins: means and variances of both states, the share of the first, and the row it keeps.
BEGIN = (0.001, 0.0004, -0.001, 0.0009, 0.5)
STATE = "m1 double, v1 double, m2 double, v2 double, p double, n long, fast long, drifts long, errors array<double>, last date"
OUT = "ticker {ticker}, date date, n long, bull double, mean_bull double, mean_bear double, decay double, drifts long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Learnt(NamedTuple):
    """Two Gaussian states, the share of the first, values seen, steps of fast learning left, drifts so far, the last errors."""

    m1: float = BEGIN[0]
    v1: float = BEGIN[1]
    m2: float = BEGIN[2]
    v2: float = BEGIN[3]
    p: float = BEGIN[4]
    n: int = 0
    fast: int = 0
    drifts: int = 0
    errors: tuple[float, ...] = ()


def divergence(errors: tuple[float, ...], bins: int = 10) -> float:
    """Divergence of the older half from the newer one over equal bins of their common range."""
    low, high = min(errors), max(errors)
    if high - low < 1e-10:
        return 0.0
    # counted in plain Python: for a score of values a step, array calls cost many times the work
    start, stop, half = low - 1e-10, high + 1e-10, len(errors) // 2
    step = (stop - start) / bins
    edges = [k * step + start for k in range(bins)]
    old, new = [1e-10] * bins, [1e-10] * bins
    for k, x in enumerate(errors):
        (old if k < half else new)[bisect_right(edges, x) - 1] += 1
    a, b = sum(old), sum(new)
    return sum(p / a * math.log((p / a) / (q / b)) for p, q in zip(old, new, strict=True))


def stepped(s: Learnt, x: float, decay: float = 0.97, most: float = math.inf, window: int = 20, faster: float = 0.8) -> tuple[Learnt, float]:
    """The state after ``x``, and the decay that this step used.

    A divergence beyond ``most`` among the last ``window`` errors multiplies the decay by
    ``faster`` for the next ``window`` steps, this one included.
    """
    errors, fast, drifts = s.errors, s.fast, s.drifts
    if most < math.inf:
        errors = (*errors, x - (s.p * s.m1 + (1 - s.p) * s.m2))[-window:]
        if len(errors) >= window and divergence(errors) > most:
            fast, drifts = window, drifts + 1
    used = decay * faster if fast else decay
    one, two = (q * math.exp(-((x - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v) for q, m, v in ((s.p, s.m1, s.v1), (1 - s.p, s.m2, s.v2)))
    p = one / (one + two) if one + two else s.p
    p = min(0.999, max(0.001, 0.9 * p + 0.05))
    r1, r2 = (1 - used) * p, (1 - used) * (1 - p)
    m1, m2 = s.m1 + r1 * (x - s.m1), s.m2 + r2 * (x - s.m2)
    v1, v2 = max((1 - r1) * s.v1 + r1 * (x - m1) ** 2, 1e-8), max((1 - r2) * s.v2 + r2 * (x - m2) ** 2, 1e-8)
    return Learnt(m1, v1, m2, v2, p, s.n + 1, max(0, fast - 1), drifts, errors), used


class Regimes(StatefulProcessor):
    """One state a ticker; each epoch gives the state after the epoch's last row of every ticker in it.

    Rows of an epoch are taken by date. A row dated before the state's last one has come
    too late and is passed over; a null value changes nothing; a row whose ``reset`` is
    true puts the ticker back to the beginning before its value is taken.
    """

    def __init__(self, decay: float, most: float, key_name: str = "ticker") -> None:
        self.decay, self.most, self.key_name = decay, most, key_name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("regime", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("date", kind="stable")
        state, last = Learnt(), None
        if self.held.exists():
            *numbers, errors, last = self.held.get()
            state = Learnt(*numbers, tuple(errors))
        used = self.decay
        for date, value, reset in zip(new["date"], new["value"], new["reset"], strict=True):
            if last is not None and date < last:
                continue
            last = date
            if reset is True or reset == 1:
                state = Learnt()
            if value is not None and not math.isnan(value):
                state, used = stepped(state, float(value), self.decay, self.most)
        if last is None:
            return
        self.held.update((*state[:-1], list(state.errors), last))
        yield pd.DataFrame({self.key_name: [key[0]], "date": [last], "n": [state.n], "bull": [state.p], "mean_bull": [state.m1], "mean_bear": [state.m2], "decay": [used], "drifts": [state.drifts]})

    def close(self) -> None:
        pass


def learnt(stream: DataFrame, decay: float = 0.97, most: float = math.inf) -> DataFrame:
    """The states of a stream of ticker, date, value and reset, as they stand after each epoch (update mode)."""
    kind = stream.schema["ticker"].dataType.simpleString()
    return stream.groupBy("ticker").transformWithStateInPandas(Regimes(decay, most), OUT.format(ticker=kind), "Update", "None")


def kept(states: DataFrame, table: str, checkpoint: str) -> None:
    """Run a stream of :func:`learnt` over all input that is there now; each epoch's states are a folder of ``table``.

    Run again with the same checkpoint it goes on where it stopped, state included.
    """
    spark = states.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    try:
        states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
