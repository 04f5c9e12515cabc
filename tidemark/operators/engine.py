"""Accounts that live through days: one cash account and one book of holdings a run, over all of its tickers.

A run's days come in order through one task, in Arrow batches, so that neither its bars
nor its history need fit into memory: what is kept is the book, each ticker's last price
and what the strategy remembers. Runs are dealt out over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Holdings below this are none.
DUST = 1e-6
HISTORY = "run {run}, date date, equity double, cash double, n_held long, unfilled double, trades array<struct<ticker:{ticker},quantity:double,price:double,fee:double>>"


class Day(NamedTuple):
    """What a run's day brings: the date as a day number, and closes, volumes and target weights by ticker."""

    date: int
    close: dict
    volume: dict
    weight: dict


class Account:
    """Cash, shares by ticker, last prices, what orders left unfilled, and a strategy's memory."""

    def __init__(self, cash: float) -> None:
        self.cash = cash
        self.shares: dict = {}
        self.price: dict = {}
        self.unfilled: dict = {}
        self.memory: dict = {}

    def equity(self) -> float:
        """Cash and holdings at their last prices."""
        return self.cash + sum(n * self.price[t] for t, n in self.shares.items())


#: Says which orders (ticker, signed quantity) a day calls for; they are filled in the order given.
Strategy = Callable[[Day, Account], list[tuple[object, float]]]


def filled(account: Account, ticker: object, quantity: float, volume: float | None, slip: float, rate: float, share: float | None) -> tuple | None:
    """Fill an order and say (ticker, quantity, price, fee), or None where there is no price, no volume or too little cash.

    At most ``share`` of a known volume is filled, the rest is noted; a price slips
    against the order; a purchase that cash doesn't cover with its fee is not made at all.
    """
    price = account.price.get(ticker)
    if not quantity or price is None or price <= 0:
        return None
    done = quantity
    if share is not None and volume is not None:
        done = float(np.copysign(min(abs(quantity), volume * share), quantity))
    if done != quantity:
        account.unfilled[ticker] = account.unfilled.get(ticker, 0.0) + quantity - done
    if not done:
        return None
    price *= 1 + slip if done > 0 else 1 - slip
    fee = abs(done * price) * rate
    if done > 0 and account.cash < done * price + fee:
        return None
    account.cash -= done * price + fee
    held = account.shares.get(ticker, 0.0) + done
    if abs(held) < DUST:
        account.shares.pop(ticker, None)
    else:
        account.shares[ticker] = held
    return ticker, done, price, fee


def rebalancing(every: int = 30) -> Strategy:
    """Every ``every`` days the book is brought to the newest target weights of equity: sales first, then purchases by weight."""

    def orders(day: Day, account: Account) -> list[tuple[object, float]]:
        memory = account.memory
        if day.weight:
            memory["weight"] = day.weight
        if not day.close or day.date < memory.get("next", day.date):
            return []
        memory["next"] = day.date + every
        if not memory.get("weight"):
            return []
        equity, price = account.equity(), account.price
        wanted = {t: equity * w / price[t] for t, w in sorted(memory["weight"].items(), key=lambda x: (-x[1], x[0])) if price.get(t, 0) > 0}
        sales = [(t, wanted.get(t, 0.0) - n) for t, n in sorted(account.shares.items()) if wanted.get(t, 0.0) < n]
        return sales + [(t, n - account.shares.get(t, 0.0)) for t, n in wanted.items() if n > account.shares.get(t, 0.0)]

    return orders


def trending(part: float = 0.02) -> Strategy:
    """A name is bought for ``part`` of equity while its close is above the mean of its closes so far, and sold out below it."""

    def orders(day: Day, account: Account) -> list[tuple[object, float]]:
        means = account.memory.setdefault("means", {})
        sales, buys, equity = [], [], account.equity()
        for t in sorted(day.close):
            close = day.close[t]
            n, mean = means.get(t, (0, 0.0))
            mean += (close - mean) / (n + 1)
            means[t] = n + 1, mean
            held = account.shares.get(t, 0.0)
            if held and close < mean:
                sales.append((t, -held))
            elif not held and close > mean:
                buys.append((t, float(part * equity // close)))
        return sales + buys

    return orders


def days(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, dict[str, list], pa.Schema]]:
    """Rows that come sorted by ``keys``, one group at a time: its key (dates as day numbers), its columns as lists, and the schema. Groups may lie across batches."""
    at, held = None, {}
    for batch in batches:
        columns = {n: (c.cast(pa.int32()) if pa.types.is_date(c.type) else c).to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        each = list(zip(*[columns[k] for k in keys], strict=True))
        edges = [k for k in range(len(each)) if not k or each[k] != each[k - 1]] + [len(each)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = {n: c[a:b] for n, c in columns.items()}
            if each[a] == at:
                held = {n: held[n] + c for n, c in part.items()}
                continue
            if at is not None:
                yield at, held, batch.schema
            at, held = each[a], part
    if at is not None:
        yield at, held, batch.schema


def lived(rows: DataFrame, strategy: Strategy, cash: float = 1_000_000.0, slip_bps: float = 10.0, rate: float = 0.001, share: float | None = 0.1) -> DataFrame:
    """run, date, equity, cash, n_held, unfilled and trades of every day with a bar of every run.

    ``rows`` has run, date, ticker, close, volume and weight: bars (weight null) and
    targets (close null) as they become known; a column slip_bps, one value a run, takes
    the place of the parameter. Rows without run, date or ticker are left out; of a
    ticker's rows in a day the largest non-null values count.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("run", "ticker")}
    slip = F.col("slip_bps") if "slip_bps" in rows.columns else F.lit(slip_bps)
    known = rows.where("run IS NOT NULL AND date IS NOT NULL AND ticker IS NOT NULL")
    daily = known.groupBy("run", "date", "ticker").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in ("close", "volume", "weight")], F.max(slip.cast("double")).alias("slip"))
    ordered = daily.repartition("run").sortWithinPartitions("run", "date", "ticker")
    schema = HISTORY.format(**kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, at, types = Account(cash), None, None
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["run", "date", "equity", "cash", "n_held", "unfilled", "trades"])

        for (name, date), rows, fields in days(batches, "run", "date"):
            if types is None:
                trade = pa.struct([("ticker", fields.field("ticker").type), ("quantity", pa.float64()), ("price", pa.float64()), ("fee", pa.float64())])
                types = [fields.field("run").type, pa.date32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(trade)]
            if name != at:
                account, at = Account(cash), name
            close, volume, weight = ({t: v for t, v in zip(rows["ticker"], rows[c], strict=True) if v is not None} for c in ("close", "volume", "weight"))
            account.price.update(close)
            made = []
            for ticker, quantity in strategy(Day(date, close, volume, weight), account):
                if done := filled(account, ticker, quantity, volume.get(ticker), rows["slip"][0] / 1e4, rate, share):
                    made.append(dict(zip(("ticker", "quantity", "price", "fee"), done, strict=True)))
            if close:
                out.append((name, date, account.equity(), account.cash, len(account.shares), float(sum(account.unfilled.values())), made))
            if len(out) >= 1000:
                yield flushed()
        if out:
            yield flushed()

    return ordered.mapInArrow(run, schema)


def trades(history: DataFrame) -> DataFrame:
    """run, date, ticker, side, quantity, price, fee: one row for each trade of a history."""
    each = history.select("run", "date", F.inline("trades"))
    return each.select("run", "date", "ticker", F.when(F.col("quantity") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("quantity").alias("quantity"), "price", "fee")
