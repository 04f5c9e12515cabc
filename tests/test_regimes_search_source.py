"""Decoding against enumeration, genetic search against numpy, and a tick source read again."""

from __future__ import annotations

import itertools
import json
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evolution as E
from tidemark.operators import regimes as H
from tidemark.plans import QUERIES
from tidemark.streaming import source

SF = "/root/testdata/sf0.001"


def enumerated(x, chain):
    """Every path's probability density."""
    out = {}
    for path in itertools.product((0, 1), repeat=len(x)):
        p = chain.start[path[0]]
        for t, s in enumerate(path):
            p *= np.exp(-((x[t] - chain.mean[s]) ** 2) / (2 * chain.var[s])) / np.sqrt(2 * np.pi * chain.var[s])
            p *= chain.moves[path[t - 1], s] if t else 1.0
        out[path] = p
    return out


@pytest.mark.parametrize("seed", range(8))
def test_paths_and_odds_against_enumeration(seed):
    draw = np.random.default_rng(seed)
    stay = draw.uniform(0.5, 0.99, 2)
    chain = H.Chain(np.array([0.3, 0.7]), np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]]), np.array([0.02, -0.03]), np.array([0.0004, 0.002]))
    x = draw.normal(0, 0.04, 10)
    every = enumerated(x, chain)
    assert tuple(H.decoded(x, chain)) == max(every, key=every.get)
    post, moves, told = H.smoothed(x, chain)
    total = sum(every.values())
    assert told == pytest.approx(np.log(total))
    for t in range(10):
        assert post[t, 1] == pytest.approx(sum(p for path, p in every.items() if path[t]) / total)
    for a, b in itertools.product((0, 1), repeat=2):
        assert moves[a, b] == pytest.approx(sum(p * sum(path[t] == a and path[t + 1] == b for t in range(9)) for path, p in every.items()) / total)


def test_fits_find_the_states():
    draw = np.random.default_rng(1)
    state = np.repeat([0, 1, 0, 1], 60)
    x = np.where(state == 0, draw.normal(0.01, 0.005, 240), draw.normal(-0.01, 0.02, 240))
    chain = H.fitted(x)
    good = chain.bull()
    assert 1 < chain.rounds <= 100 and chain.mean[good] == pytest.approx(0.01, abs=0.003) and chain.var[good] < chain.var[1 - good]
    assert (H.decoded(x, chain) == np.where(state == 0, good, 1 - good)).mean() > 0.95
    told = [H.smoothed(x, H.fitted(x, k))[2] for k in (1, 2, 5, 20)]
    assert told == sorted(told)


def test_regimes_of_awkward_tickers(spark):
    day = lambda k: date(2020, 1, 1) + timedelta(days=k)
    rows = [(1, day(k), 0.01 * ((k * 37) % 11 - 5), "x") for k in range(300)] + [(2, day(k), 0.01, "x") for k in range(60)] + [(3, day(k), 0.01, "x") for k in range(49)] + [(4, day(1), None, "x"), (4, day(2), float("nan"), "x"), (4, day(3), float("inf"), "x")]
    out = H.regime_paths(spark.createDataFrame(rows, "ticker long, date date, ret double, regime string"), "ret").collect()
    sizes = {t: [r for r in out if r.ticker == t] for t in (1, 2, 3, 4)}
    assert [len(sizes[t]) for t in (1, 2, 3, 4)] == [252, 60, 49, 0]
    assert {r.regime for r in sizes[3]} == {"Unknown"} and {r.multiplier for r in sizes[3]} == {0.75} and {r.regime for r in sizes[1]} <= {"Bull", "Bear"}
    assert all(0 <= r.bull <= 1 for r in out)
    last = QUERIES["x18_hidden_regimes"](spark, SF).collect()
    path = {(r.ticker, r.date): r for r in QUERIES["x18_regime_path"](spark, SF).collect()}
    for r in last:
        mine = max((k for k in path if k[0] == r.ticker), key=lambda k: k[1])
        assert (path[mine].regime, path[mine].bull) == (r.regime, r.bull)


# --- genetic search


@pytest.fixture(scope="module")
def months(spark):
    draw = np.random.default_rng(3)
    rows = []
    for m in range(36):
        for t in range(12):
            a, b = draw.normal(size=2)
            rows.append((m, t, float(a), float(b), float(0.02 * a - 0.01 * b + draw.normal(0, 0.03)), "x"))
    rows += [(0, 99, None, 1.0, 0.5, "x"), (None, 98, 1.0, 1.0, 0.5, "x")]
    return rows, E.factor_returns(spark.createDataFrame(rows, "m int, t int, a double, b double, y double, months string"), "m", ["a", "b"], "y")


def test_fitness_and_generations(months):
    rows, table = months
    earned = np.array([np.mean([[a * y, b * y] for m, _, a, b, y, _ in rows if m == k and a is not None], axis=0) for k in range(36)])
    ranges = [(-1.0, 1.0), (-2.0, 0.5)]
    got = E.evolved(table, ranges, 24, 4, 7).collect()
    assert len(got) == 4 * 24 and len({(r.generation, r.k) for r in got}) == 96
    for r in got:
        x = earned @ np.array(r.genes) / np.abs(r.genes).sum()
        assert r.fitness == pytest.approx(x.mean() / x.std(ddof=1) * 12**0.5, rel=1e-9)
        assert all(low <= g <= high for g, (low, high) in zip(r.genes, ranges, strict=True))
    best = [max(r.fitness for r in got if r.generation == g) for g in range(4)]
    assert best == sorted(best)
    mean = [np.mean([r.fitness for r in got if r.generation == g]) for g in range(4)]
    assert mean[3] > mean[0]
    assert sorted(map(tuple, got)) == sorted(map(tuple, E.evolved(table, ranges, 24, 4, 7).collect()))
    assert sorted(map(tuple, got)) != sorted(map(tuple, E.evolved(table, ranges, 24, 4, 8).collect()))


def test_children_come_from_their_parents(spark, monkeypatch):
    """Without mutation each gene is one of its tournament's or its mate's, and winners are the fittest drawn."""
    monkeypatch.setattr(E, "MUTATE", 0.0)
    scored = spark.createDataFrame([(k, [float(k), 100.0 + k, 200.0 + k], None if k == 3 else float(k % 7)) for k in range(20)], "k long, genes array<double>, fitness double")
    got = {r.k: r.genes for r in E.bred(scored, 20, [(0.0, 99.0), (100.0, 199.0), (200.0, 299.0)], 5, 1).collect()}
    assert set(got) == set(range(20)) and got[0] == [6.0, 106.0, 206.0]
    assert all([g // 100 for g in genes] == [0, 1, 2] for genes in got.values())
    assert any(len({g % 100 for g in genes}) > 1 for genes in got.values())
    assert np.mean([genes[0] % 7 for genes in got.values()]) > 3.5


def test_search_over_nothing(months, spark):
    _, table = months
    empty = E.factor_returns(spark.createDataFrame([], "m int, a double, b double, y double"), "m", ["a", "b"], "y")
    got = E.evolved(empty, [(0.0, 1.0)] * 2, 4, 2, 1).collect()
    assert len(got) == 8 and {r.fitness for r in got} == {None}


# --- tick source


def test_offsets_are_read_again_the_same():
    options = {"prices": json.dumps({"a": 100.0, "b": 50.0}), "rows": "7", "total": "20", "seed": "3"}
    one, other = source.TickReader(options), source.TickReader(options)
    offsets = [one.initialOffset()]
    while (now := one.latestOffset()) != offsets[-1]:
        offsets.append(json.loads(json.dumps(now)))
    assert [o["step"] for o in offsets] == [0, 7, 14, 20]
    rows = lambda reader, a, b: [tuple(r.values()) for p in reader.partitions(a, b) for batch in reader.read(p) for r in batch.to_pylist()]
    whole = sorted(rows(one, offsets[0], offsets[-1]))
    parts = sorted(r for a, b in itertools.pairwise(offsets) for r in rows(other, a, b))
    assert [r[:3] + r[4:] for r in whole] == [r[:3] + r[4:] for r in parts] and np.allclose([r[3] for r in whole], [r[3] for r in parts])
    assert rows(other, offsets[1], offsets[2]) == rows(source.TickReader(options), offsets[1], offsets[2])
    resumed = source.TickReader(options)
    resumed.partitions(offsets[0], offsets[2])
    assert resumed.latestOffset()["step"] == 20
    for name, start in (("a", 100.0), ("b", 50.0)):
        prices = [start, *[r[3] for r in whole if r[0] == name]]
        assert len(prices) == 21 and all(abs(b / a - 1) <= 0.005 for a, b in itertools.pairwise(prices))
    assert all(10 <= r[4] <= 1000 for r in whole) and len({r[4] for r in whole}) > 20
    assert rows(one, offsets[0], offsets[0]) == []


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(source.TickSource)
    for total in ("30", "50"):
        ticks = spark.readStream.format("tidemark_ticks").options(prices='{"a": 10.0}', rows="20", total=total).load()
        run = ticks.writeStream.format("parquet").option("path", str(tmp_path / "ticks")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        run.processAllAvailable()
        run.stop()
    rows = spark.read.schema(source.SCHEMA).parquet(str(tmp_path / "ticks")).orderBy("step").collect()
    assert [r.step for r in rows] == list(range(1, 51))
    assert np.allclose([r.price for r in rows], source.walk(42, 0, 0, 50, 10.0))
    assert spark.read.schema(source.SCHEMA).parquet(str(tmp_path / "ticks")).where(F.col("volume").isNull()).count() == 0
