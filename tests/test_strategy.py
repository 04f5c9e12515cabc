"""Optimised universes by their optimality conditions, fallbacks, volatility targets, trade lists, registries and configurations."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import optimiser as O
from tidemark.operators import plugins as G
from tidemark.operators import portfolio as P
from tidemark.operators import xsec as X
from tidemark.plans import QUERIES

SF = "/root/testdata/sf0.001"
ENDS = [date(2020, 6, 30), date(2020, 7, 31), date(2020, 8, 31)]


@pytest.fixture(scope="module")
def market(spark):
    """Closes of nine names with gaps, one that begins late, one without any; and their universes."""
    draw = np.random.default_rng(4)
    rows, price = [], np.full(9, 50.0)
    for k in range(250):
        price = price * (1 + draw.normal(0.0004, 0.01 + 0.003 * np.arange(9)))
        day = date(2020, 1, 1) + timedelta(days=k)
        rows += [(t, day, float(p), 1.0) for t, p in enumerate(price) if draw.random() < 0.9 and (t != 8 or k > 120)]
    rows += [(0, date(2020, 5, 5), None, 1.0), (1, None, 3.0, 1.0)]
    bars = spark.createDataFrame(rows, "ticker long, date date, close double, volume double")
    wanted = [(d, m, t, float(np.sin(t + 3 * k)), None if t == 5 and m == "bl" else float(t + 1) * 100, "x") for k, d in enumerate(ENDS) for m in ("hrp", "bl", "kelly", "mvo", "none") for t in range(10)]
    return bars, spark.createDataFrame(wanted, "as_of date, method string, ticker long, score double, cap double, closes string")


def history(bars, as_of, names):
    """Returns of a year up to a date, by pandas."""
    rows = bars.where(F.col("close").isNotNull()).toPandas().dropna(subset=["date"])
    rows = rows[(rows["date"] <= as_of) & (rows["date"] > as_of - timedelta(days=365)) & rows["ticker"].isin(names)]
    return rows.pivot_table(index="date", columns="ticker", values="close", aggfunc="max").ffill().dropna().pct_change(fill_method=None).dropna()


def test_weights_of_each_group_meet_their_conditions(market):
    bars, universes = market
    got = O.optimised(universes.drop("closes"), bars).toPandas()
    scores = universes.toPandas().set_index(["as_of", "method", "ticker"])
    assert set(got["ticker"]) == set(range(9))  # 9 has no closes
    assert len(got) == 3 * 5 * 9
    for (as_of, method), part in got.groupby(["as_of", "method"]):
        part = part.sort_values("ticker")
        w = part["weight"].to_numpy()
        assert w.min() >= 0 and w.sum() == pytest.approx(1.0)
        assert set(part["used"]) == {"equal" if method == "none" else method}
        cov = history(bars, as_of, part["ticker"]).cov().to_numpy() * 252
        score = np.array([scores.loc[(as_of, method, t), "score"] for t in part["ticker"]])
        if method == "none":
            assert np.allclose(w, 1 / 9)
        if method == "mvo":
            assert w.max() <= 0.1 / 0.9 + 1e-9 + 0.02  # 9 names can't all stay below a tenth: the cap is an equal share
        if method == "kelly":
            raw = P.kelly(score * 0.05, cov) * 2
            slope = score * 0.05 - cov @ raw
            held = raw > 1e-9
            level = slope[held].max() if raw.sum() > 1 - 1e-9 else 0.0
            assert np.allclose(slope[held], level, atol=1e-7) and (slope[~held] <= level + 1e-7).all()
            clean = np.where(raw / 2 < 0.001, 0, raw / 2)
            assert np.allclose(w, clean / clean.sum(), atol=1e-9)


@pytest.mark.parametrize("seed", range(12))
def test_solvers_meet_the_optimality_conditions(seed):
    draw = np.random.default_rng(seed)
    n, cap = draw.integers(2, 30), 0.25
    x = draw.normal(size=(60, n)) * draw.uniform(0.05, 0.4, n)
    cov, mu = np.cov(x, rowvar=False) + 1e-8 * np.eye(n), draw.normal(0, 0.1, n)
    w = P.mean_variance(mu, cov, 2.0, cap)
    cap = max(cap, 1 / n)
    slope = mu - 2 * cov @ w
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= cap + 1e-9
    free = (w > 1e-7) & (w < cap - 1e-7)
    level = slope[free].mean() if free.any() else (slope[w >= cap - 1e-7].min() + slope[w <= 1e-7].max(initial=-np.inf)) / 2
    if np.isfinite(level):
        assert np.allclose(slope[free], level, atol=1e-5)
        assert (slope[w <= 1e-7] <= level + 1e-5).all() and (slope[w >= cap - 1e-7] >= level - 1e-5).all()
    w = P.kelly(mu, cov, 1.0, 1.0)
    slope = mu - cov @ w
    level = 0.0 if w.sum() < 1 - 1e-7 else slope[w > 1e-7].mean()
    assert level >= -1e-6 and np.allclose(slope[w > 1e-7], level, atol=1e-5) and (slope[w <= 1e-7] <= level + 1e-5).all()


def test_kelly_of_uncorrelated_names():
    w = P.kelly(np.array([0.20, 0.05, -0.10]), np.diag([0.04, 0.0025, 0.0225]), 30.0, 1.0)
    assert np.allclose(w, [5, 20, 0], atol=1e-6)
    assert P.kelly(np.array([0.2, 0.05, -0.1]), np.diag([0.04, 0.0025, 0.0225]), 1.0, 0.5).sum() == pytest.approx(0.5)


def test_trees_of_distances():
    near = np.array([[0, 1, 5, 6], [1, 0, 4, 7], [5, 4, 0, 2], [6, 7, 2, 0]], float)
    for linkage in ("single", "ward"):
        order = P.linked(near, linkage)
        assert sorted(order) == [0, 1, 2, 3] and {frozenset(order[:2]), frozenset(order[2:])} == {frozenset((0, 1)), frozenset((2, 3))}
        w = P.hierarchical(np.diag([0.01, 0.04, 0.09, 0.16]), linkage)
        assert w.sum() == pytest.approx(1) and w[0] > w[1]
    assert P.linked(np.zeros((1, 1))) == [0] and P.linked(np.zeros((0, 0))) == []


def test_volatility_targets():
    draw = np.random.default_rng(42)
    moves = draw.normal(0, 0.30 / 252**0.5, (100, 1))
    now = pd.Series(moves[:, 0]).ewm(span=20).std().iloc[-1] * 252**0.5
    assert O.vol_scale(np.ones(1), moves, 0.15) == pytest.approx(0.15 / now, abs=1e-9)
    assert O.vol_scale(np.ones(1), moves, 15.0) == 2.0
    assert O.vol_scale(np.ones(1), moves[:19], 0.15) == O.vol_scale(np.ones(1), moves * 0, 0.15) == 1.0


def test_methods_fall_back():
    score, none = np.array([1.0, 0.5, -1.0]), np.zeros((0, 3))
    assert O.solved("bl", score, np.ones(3), np.random.default_rng(0).normal(size=(50, 3)))[0] == "hrp"
    assert O.solved("hrp", score, np.ones(3), none)[0] == "mvo"
    assert O.solved("kelly", -np.ones(3), np.ones(3), np.random.default_rng(0).normal(size=(50, 3)))[0] == "mvo"
    assert O.solved("unheard", score, np.ones(3), none)[0] == "equal"


def test_models_are_asked_in_order(spark):
    day = lambda k: date(2020, 1, k)
    rows = [("v2", day(k), t, float(t), "z") for k in (1, 2, 3) for t in range(3)] + [("v3", day(2), t, float(-t), "z") for t in range(4)] + [("v3", day(4), 1, None, "z"), ("v9", day(5), 1, 9.0, "z")]
    signals = spark.createDataFrame(rows, "model_name string, date date, ticker long, score double, as_of_ string")
    dates = spark.createDataFrame([(date(2019, 12, 31),), (day(1),), (day(2),), (day(3),), (day(9),), (day(9),), (None,)], "as_of date")
    got = {(r.as_of.day, r.model_name, r.date.day, r.ticker) for r in O.chosen(signals, dates, ("v3", "v2"), 2).collect()}
    assert got == {(1, "v2", 1, 2), (1, "v2", 1, 1), (2, "v3", 2, 0), (2, "v3", 2, 1), (3, "v2", 3, 2), (3, "v2", 3, 1), (9, "v3", 2, 0), (9, "v3", 2, 1)}


def test_trade_lists(spark):
    targets = spark.createDataFrame([(ENDS[0], 1, 0.5), (ENDS[0], 2, 0.4), (ENDS[0], 3, 0.0005), (ENDS[1], 1, 0.3), (ENDS[1], 3, 0.7), (ENDS[2], 1, 0.3), (ENDS[2], 3, 0.9)], "as_of date, ticker long, weight double")
    bars = spark.createDataFrame([(t, date(2020, 1, 1), 10.0 * t) for t in (1, 2, 3)] + [(1, date(2020, 12, 1), 99.0)], "ticker long, date date, close double")
    names = spark.createDataFrame([(1, "one", "a"), (2, "two", None)], "ticker long, name string, sector string")
    got = {(r.as_of.month, r.ticker): (r.action, r.shares, r.sector) for r in O.trade_list(targets, bars, names, 1000.0).collect()}
    assert got == {
        (6, 1): ("BUY", 50, "a"), (6, 2): ("BUY", 20, "Unknown"), (7, 1): ("TRIM", 30, "a"), (7, 2): ("SELL", 0, "Unknown"), (7, 3): ("BUY", 23, "Unknown"),
        (8, 1): ("HOLD", 30, "a"), (8, 3): ("ADD", 30, "Unknown"),
    }


def test_registries():
    own = G.Registry("thing", G.Optimiser)

    @own.register("halves")
    class Halves:
        otherwise = "equal"

        def optimise(self, score, cov, caps):
            return np.full(len(score), 0.5)

    assert isinstance(own.get("halves"), G.Optimiser) and own.accepts("halves") == []
    with pytest.raises(ValueError, match="already"):
        own.register("halves")(Halves)
    with pytest.raises(TypeError):
        own.register("nothing")(object)
    with pytest.raises(KeyError, match="halves"):
        own.get("thirds")
    assert own.discover("tidemark.functions") == []
    assert all(isinstance(G.OPTIMISERS.get(n), G.Optimiser) for n in ("hrp", "bl", "kelly", "mvo"))
    assert all(isinstance(G.RISKS.get(n), G.RiskCheck) for n in ("max_weight", "sector", "beta"))


def test_configurations(spark):
    config = [("factor", "levy", '{"n": 2}', None, True), ("factor", "amihud", "not json", 1.0, True), ("factor", "levy", "[1]", 1.0, None), ("risk", "beta", '{"least": 0.5}', 0.5, None), (None, None, None, None, None)]
    assert [r.status for r in G.told(spark, config).collect()] == ["ok", "params are no JSON object", "params are no JSON object", "ok", "unknown kind"]
    rows = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", 3.0, None), (3, "a", None, None), (4, "b", 2.0, 1.0)], "ticker long, as_of string, f_levy double, f_x double")
    got = {r.ticker: r.score for r in G.blended(rows, config, "as_of", X.z_score).collect()}
    assert got == {1: pytest.approx(-(0.5**0.5)), 2: pytest.approx(0.5**0.5), 3: None, 4: 0.0}
    book = spark.createDataFrame([(date(2020, 1, 1), 1, "a", 0.4, 2.0), (date(2020, 1, 1), 2, None, 0.6, None)], "as_of date, ticker long, sector string, weight double, beta double")
    checks = {r.rule: (r.passed, r.worst, r.violators) for r in G.risks(book, [("risk", "max_weight", None, None, True), ("risk", "sector", '{"most": 0.5}', None, True), ("risk", "beta", None, None, True)]).collect()}
    assert checks == {"max_weight": (False, 0.6, "1,2"), "sector": (False, 0.6, "Unknown"), "beta": (False, pytest.approx(1.4), "")}
    assert G.risks(book, []) is None


def test_the_score_of_the_query_keeps_its_bound(spark):
    rows = QUERIES["l07_orthogonal_alpha"](spark, SF).toPandas().dropna()
    for factor in ("bab", "vol"):
        assert abs(np.corrcoef(rows["alpha"], rows[factor])[0, 1]) < 0.0501
    assert rows["alpha"].std() > 0
