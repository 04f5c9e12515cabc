"""A tick source for Structured Streaming: seeded random walks, read again the same from the same offsets.

Register it with ``spark.dataSource.register(TickSource)`` and read ``format("tidemark_ticks")``.
Each symbol moves by up to half a percent a step. An offset holds the step and each
symbol's price there, so a reader begins anywhere without replaying what lay before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Half a percent a step, and shares a tick.
MOST_MOVE = 0.005
VOLUME = (10, 1000)
SCHEMA = "symbol string, step long, ts timestamp, price double, volume long"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _noise(seed: int, symbol: int, steps: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number of [0, 1) for each step: a mixed counter, so any step can be had by itself."""
    with np.errstate(over="ignore"):
        x = steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + symbol * 7_919 + salt) & 0xFFFFFFFF) * np.uint64(0xD1B54A32D192ED03)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times) & _MASK
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def walk(seed: int, symbol: int, first: int, last: int, price: float) -> np.ndarray:
    """Prices of the steps after ``first`` up to ``last``, from the price at ``first``."""
    moves = (2 * _noise(seed, symbol, np.arange(first + 1, last + 1), 1) - 1) * MOST_MOVE
    return price * np.cumprod(1 + moves)


class Part(InputPartition):
    """One symbol's steps after ``first`` up to ``last``."""

    def __init__(self, symbol: str, number: int, first: int, last: int, price: float) -> None:
        self.symbol, self.number, self.first, self.last, self.price = symbol, number, first, last, price


class TickReader(DataSourceStreamReader):
    """Batches of ``rows`` steps of every symbol, up to ``total`` steps in all."""

    def __init__(self, options: dict) -> None:
        self.seed, self.rows, self.total = int(options.get("seed", 42)), int(options.get("rows", 100)), int(options.get("total", 1000))
        self.prices = json.loads(options.get("prices", '{"TICK": 100.0}'))
        self.begin = datetime.fromisoformat(options.get("begin", "2024-01-01T00:00:00+00:00"))
        self.names = sorted(self.prices)
        self.at = {"step": 0, "prices": self.prices}

    def initialOffset(self) -> dict:
        return {"step": 0, "prices": self.prices}

    def latestOffset(self) -> dict:
        step = min(self.at["step"] + self.rows, self.total)
        if step > self.at["step"]:
            moved = {s: float(walk(self.seed, k, self.at["step"], step, self.at["prices"][s])[-1]) for k, s in enumerate(self.names)}
            self.at = {"step": step, "prices": moved}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if end["step"] > self.at["step"]:  # after a restart: go on from what was read
            self.at = end
        return [Part(s, k, start["step"], end["step"], start["prices"][s]) for k, s in enumerate(self.names)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        steps = np.arange(part.first + 1, part.last + 1)
        if not len(steps):
            return
        price = walk(self.seed, part.number, part.first, part.last, part.price)
        volume = VOLUME[0] + np.floor(_noise(self.seed, part.number, steps, 2) * (VOLUME[1] - VOLUME[0] + 1)).astype(np.int64)
        begin = self.begin if self.begin.tzinfo else self.begin.replace(tzinfo=UTC)
        ts = pa.array([begin + timedelta(seconds=int(s)) for s in steps], pa.timestamp("us", "UTC"))
        yield pa.record_batch([pa.array([part.symbol] * len(steps)), pa.array(steps), ts, pa.array(price), pa.array(volume)], ["symbol", "step", "ts", "price", "volume"])

    def commit(self, end: dict) -> None:
        pass


class TickSource(DataSource):
    """Options: prices (JSON of each symbol's first price), seed, rows (steps a batch), total (steps in all), begin (ISO time of step 0)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_ticks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TickReader:
        return TickReader(self.options)
