"""Accounts against a plain loop, and streamed regimes against the fold, over restarts and awkward rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import engine as E
from tidemark.plans import QUERIES
from tidemark.sources import views as V
from tidemark.streaming import regimes as G

SF = "/root/testdata/sf0.001"
ROWS = "run string, date date, ticker long, close double, volume double, weight double, slip_bps double, cash string"


def made(seed: int) -> list[tuple]:
    """Bars with missing days, nulls and zero prices, and targets, some of names without bars."""
    draw, out = random.Random(seed), []
    for run in ("a", "b", "c"):
        slip = {"a": 0.0, "b": 10.0, "c": 50.0}[run]
        for k in range(120):
            day = date(2020, 1, 1) + timedelta(days=k)
            for t in range(8):
                if draw.random() < 0.8:
                    out.append((run, day, t, draw.choice([None, 0.0]) if draw.random() < 0.03 else 20 + 10 * draw.random() + t, draw.choice([None, 50.0, 1e5]), None, slip, "x"))
            if k % 17 == 3:
                names = draw.sample(range(10), 4)
                out += [(run, day, t, None, None, 0.35 if draw.random() < 0.5 else 0.2, slip, "x") for t in names]
    out += [(None, date(2020, 1, 1), 1, 5.0, 1.0, None, 0.0, "x"), ("a", None, 1, 5.0, 1.0, None, 0.0, "x"), ("a", date(2020, 1, 1), None, 5.0, 1.0, None, 0.0, "x"), ("c", date(2020, 1, 2), 1, 33.0, 10.0, None, 50.0, "x"), ("c", date(2020, 1, 2), 1, 32.0, 10.0, None, 50.0, "x")]
    return out


def plain(rows: list[tuple], start: float, rate: float, share: float | None, every: int) -> list[tuple]:
    """The same accounts, written as one loop over days."""
    out = []
    for run in sorted({r[0] for r in rows if r[0]}):
        mine = [r for r in rows if r[0] == run and r[1] and r[2] is not None]
        cash, shares, price, unfilled, weights, due = start, {}, {}, {}, {}, None
        for day in sorted({r[1] for r in mine}):
            today = [r for r in mine if r[1] == day]
            best = lambda k: {t: max(r[k] for r in today if r[2] == t and r[k] is not None) for t in sorted({r[2] for r in today if r[k] is not None})}  # noqa: B023, E731
            close, volume, target = best(3), best(4), best(5)
            price |= close
            weights = target or weights
            trades = []
            worth = lambda: cash + sum(n * price[t] for t, n in shares.items())  # noqa: B023, E731
            if close and (due is None or day >= due):
                due = day + timedelta(days=every)
                equity, wanted, orders = worth(), {}, []
                for t in sorted(weights, key=lambda t: (-weights[t], t)):  # noqa: B023
                    if price.get(t, 0) > 0:
                        wanted[t] = equity * weights[t] / price[t]
                if weights:
                    orders = [(t, wanted.get(t, 0) - shares[t]) for t in sorted(shares) if wanted.get(t, 0) < shares[t]] + [(t, n - shares.get(t, 0)) for t, n in wanted.items() if n > shares.get(t, 0)]
                for t, q in orders:
                    if not price.get(t, 0) > 0:
                        continue
                    fill = q
                    if share is not None and volume.get(t) is not None and abs(q) > share * volume[t]:
                        fill = share * volume[t] * (1 if q > 0 else -1)
                    if fill != q:
                        unfilled[t] = unfilled.get(t, 0) + q - fill
                    paid = price[t] * (1 + today[0][6] / 1e4 * (1 if fill > 0 else -1))
                    fee = abs(fill * paid) * rate
                    if fill == 0 or fill > 0 and cash < fill * paid + fee:
                        continue
                    cash -= fill * paid + fee
                    shares[t] = shares.get(t, 0) + fill
                    if abs(shares[t]) < 1e-6:
                        del shares[t]
                    trades.append((t, round(fill, 6), round(paid, 6), round(fee, 6)))
            if close:
                out.append((run, day, round(worth(), 4), round(cash, 4), len(shares), round(sum(unfilled.values()), 4), tuple(trades)))
    return out


@pytest.mark.parametrize(("seed", "share", "rate"), [(1, None, 0.001), (2, 0.1, 0.001), (3, 0.1, 0.05)])
def test_accounts_against_a_plain_loop(spark, seed, share, rate):
    rows = made(seed)
    got = E.lived(spark.createDataFrame(rows, ROWS), E.rebalancing(30), 10_000.0, rate=rate, share=share).collect()
    got = sorted((r.run, r.date, round(r.equity, 4), round(r.cash, 4), r.n_held, round(r.unfilled, 4), tuple((t.ticker, round(t.quantity, 6), round(t.price, 6), round(t.fee, 6)) for t in r.trades)) for r in got)
    want = plain(rows, 10_000.0, rate, share, 30)
    assert len(got) == len(want) == 360
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:6] == pytest.approx(w[2:6], abs=1e-3) and len(g[6]) == len(w[6])
        assert all(x == pytest.approx(y, abs=1e-5) for x, y in zip(g[6], w[6], strict=True))
    assert any(len({t[1] > 0 for t in r[6]}) == 2 for r in got)  # sales and purchases on one day
    assert all(r[3] >= -1e-6 for r in got)


def test_days_across_batches(spark):
    """One row a batch gives the same accounts."""
    rows = spark.createDataFrame(made(4), ROWS)
    whole = E.lived(rows, E.trending()).collect()
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted(E.lived(rows, E.trending()).collect()) == sorted(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert any(r.trades for r in whole)
    assert E.lived(rows.where("false"), E.trending()).count() == 0
    assert E.trades(E.lived(rows, E.trending())).where("quantity <= 0 OR side NOT IN ('BUY', 'SELL')").count() == 0


def streamed(spark, at, slices: list[list[tuple]], most: float) -> dict:
    """What each ticker's state is after all slices, the stream stopped after each."""
    schema = "ticker long, date date, value double, reset boolean"
    for k, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/k={k}")
        G.kept(G.learnt(spark.readStream.schema(schema).parquet(f"{at}/in/*"), most=most), f"{at}/out", f"{at}/checkpoint")
    got = spark.read.parquet(f"{at}/out").collect()
    return {t: max((r for r in got if r.ticker == t), key=lambda r: r.epoch) for t in {r.ticker for r in got}}


def test_states_outlast_restarts_and_adapt_to_drift(spark, tmp_path):
    draw = random.Random(6)
    series = {t: [(t, date(2020, 1, 1) + timedelta(days=k), draw.gauss(0.001 if k < 60 else -0.03, 0.01 if k < 60 else 0.05), False) for k in range(120)] for t in (1, 2)}
    series[1][30] = (1, series[1][30][1], None, False)
    series[2][90] = (2, series[2][90][1], 0.01, True)
    rows = [r for s in series.values() for r in s]
    draw.shuffle(rows)
    cut = date(2020, 2, 10)
    late = (1, date(2020, 1, 5), 0.5, False)
    got = streamed(spark, tmp_path, [[r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut] + [late]], 0.1)
    for t, values in series.items():
        state, used = G.Learnt(), 0.97
        for _, _, value, reset in values:
            state = G.Learnt() if reset else state
            if value is not None:
                state, used = G.stepped(state, value, 0.97, 0.1)
        r = got[t]
        assert (r.n, r.bull, r.mean_bull, r.mean_bear, r.decay, r.drifts) == (state.n, state.p, state.m1, state.m2, used, state.drifts)
        assert state.drifts > 0 or t == 2
    assert got[1].n == 119 and got[2].n == 30


def test_drift_makes_learning_faster_for_a_while():
    state, decays = G.Learnt(), []
    for k in range(80):
        state, used = G.stepped(state, 0.001 * (k % 3) if k < 40 else 0.2, 0.95, 3.0)
        decays.append(used)
    assert decays[:19] == [0.95] * 19 and min(decays) == pytest.approx(0.76)
    assert state.drifts > 0
    assert G.divergence((0.1,) * 20) == 0.0


def test_queries_of_the_engine(spark):
    runs = QUERIES["b10_rebalanced_accounts"](spark, SF).collect()
    days = V.bars(spark, SF).select("date").distinct().count()
    assert {r.run for r in runs} == {0, 10, 20} and len({r.date for r in runs}) <= days
    last = {r.run: r for r in sorted(runs, key=lambda r: r.date)}
    assert last[0].equity >= last[10].equity >= last[20].equity > 0
    trades = QUERIES["b10_rebalance_trades"](spark, SF)
    assert trades.groupBy("run", "date").agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0] == sum(r.n_trades for r in runs)
    for a, b in zip(sorted({r.date for r in runs if r.n_trades})[:-1], sorted({r.date for r in runs if r.n_trades})[1:], strict=True):
        assert (b - a).days >= 30
