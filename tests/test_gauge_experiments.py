"""The risk gauge, stored experiments, attributions and the two stages of residual alpha against plain computations."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors as A
from tidemark.operators import gauge as G
from tidemark.operators import learning as L
from tidemark.operators import scoring as S
from tidemark.sources import lake
from tidemark.sources import views as V

SF = "/root/testdata/sf0.001"


def series(spark, name, values, market="a"):
    return [(market, name, date(2020, 1, 1) + timedelta(k), None if v is None else float(v)) for k, v in enumerate(values)]


def found(spark, rows):
    table = spark.createDataFrame(rows, "market string, name string, date date, value double")
    return {(r["market"], r["name"]): r for r in G.indicators(table, ["market"]).collect()}


@pytest.mark.parametrize(
    ("name", "value", "score", "signal"),
    [
        ("volatility", 9, 100, "High Risk"), ("volatility", 11, 90, "High Risk"), ("volatility", 15, 60, "Neutral"), ("volatility", 28, 20, "Low Risk"), ("volatility", 50, 0, "Low Risk"),
        ("yield_10y", 4.25, 25, "Low Risk"), ("put_call", 0.75, 75, "High Risk"), ("put_call", 0.9, 50, "Neutral"), ("rate_3m", 5.5, 0, "Low Risk"), ("fear_greed", 76, 76, "High Risk"),
    ],
)
def test_last_values_are_scored(spark, name, value, score, signal):
    got = found(spark, series(spark, name, [1, 50, value, None]))["a", name]
    assert got["score"] == pytest.approx(score) and got["signal"] == signal and got["value"] == value


def test_histories_against_numpy(spark):
    x = np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 400)))
    got = found(spark, series(spark, "deviation", x) + series(spark, "smart_money", x) + series(spark, "smart_money", x[:200], "b"))
    away = np.array([x[k] / x[k - 199 : k + 1].mean() - 1 for k in range(199, 400)])
    assert got["a", "deviation"]["score"] == pytest.approx(100 * (away < away[-1]).sum() / 400)
    assert got["a", "deviation"]["value"] == pytest.approx(100 * away[-1])
    assert got["a", "smart_money"]["score"] == pytest.approx(np.clip(50 + 500 * away[-1], 0, 100))
    assert ("b", "smart_money") not in got


def test_composite_weighs_what_there_is(spark):
    rows = series(spark, "volatility", [9]) + series(spark, "fear_greed", [70]) + series(spark, "unknown", [1]) + series(spark, "yield_10y", [None])
    table = spark.createDataFrame(rows, "market string, name string, date date, value double")
    (got,) = G.composite(G.indicators(table, ["market"]), ["market"]).collect()
    assert (got["n"], got["score"], got["rating"]) == (2, 80.0, "Extreme Greed / Bubble Risk")
    assert G.composite(G.indicators(table.limit(0), ["market"]), ["market"]).count() == 0


def test_experiments_get_suffixes_and_are_listed_newest_first(spark, tmp_path):
    at = str(tmp_path / "experiments")
    assert lake.experiments(spark, at).count() == 0
    config = '{"a":1}'
    runs = spark.createDataFrame([(1, config), (2, '{"a":2}')], "run long, config string")
    curve = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 1.0), (3, 9.0)], "run long, ret double")
    for _ in range(2):
        lake.save_experiments(runs, at, "2024-01-02", curve=curve)
    lake.save_experiments(spark.createDataFrame([(7, config), (8, config)], "run long, config string"), at, "2024-01-02")
    lake.save_experiments(runs.where("run = 1"), at, "2024-01-03", curve=curve)
    names = [r["run_id"] for r in lake.experiments(spark, at).collect()]
    base = next(n for n in names if n.startswith("2024-01-03")).removeprefix("2024-01-03")
    assert sorted(n for n in names if n.startswith(f"2024-01-02{base}")) == [f"2024-01-02{base}{x}" for x in ("", "_1", "_1_2", "_1_2_3")]
    assert names == sorted(names, reverse=True) and len(names) == 7
    assert [r["run_id"] for r in lake.experiments(spark, at, 1).collect()] == [f"2024-01-03{base}"]
    assert sorted(r["ret"] for r in lake.experiment_rows(spark, at, "curve", f"2024-01-02{base}").collect()) == [0.25, 0.5]
    assert lake.experiment_rows(spark, at, "curve").count() == 8


def test_attribution_by_groups(spark):
    day = date(2024, 1, 31)
    targets = spark.createDataFrame([(day, 1, 0.6), (day, 2, 0.2), (day, 3, 0.2)], "date date, ticker long, weight double")
    said = [(day, 1, 2.5, '{"vsm":"1.5","upside":2,"valuation_composite":9}'), (day, 2, 1.0, '{"roe":4,"vsm":"none"}'), (day, 9, 5.0, '{"bab":100}')]
    (got,) = S.attributed(targets, spark.createDataFrame(said, "date date, ticker long, score double, metadata string")).collect()
    assert [got[g] for g in S.GROUPS] == pytest.approx([1.2, 0.9, 0.8, 0.0, 0.0])
    assert (got["high"], got["medium"], got["low"]) == (1, 1, 1)


def rows_of(spark, x, y, names):
    return spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], f"k long, {', '.join(f'{n} double' for n in names)}, y double")


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 200)
    table = rows_of(spark, x, y, "abc")
    for alpha in (0.0, 10.0):
        weights, intercept = L.ridge(table, "y", ["a", "b", "c"], alpha)
        own = x - x.mean(0)
        want = np.linalg.solve(own.T @ own + alpha * np.eye(3), own.T @ (y - y.mean()))
        assert list(weights.values()) == pytest.approx(want.tolist()) and intercept == pytest.approx(y.mean() - x.mean(0) @ want)
    weights, _ = L.ridge(table.withColumn("b", F.col("a") * 2), "y", ["a", "b"])
    assert np.isfinite(list(weights.values())).all()
    assert L.ridge(table.limit(0), "y", ["a"]) == ({"a": 0.0}, 0.0)


def test_second_stage_learns_what_the_first_leaves(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2))
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, 1.0, -1.0)
    out, told = L.residual_alpha(rows_of(spark, x, y, "ab"), "y", ["a"], ["b"], alpha=0.0, rounds=20, depth=2, rate=0.3)
    assert told["linear_r2"] == pytest.approx(1 - np.mean((y - np.polyval(np.polyfit(x[:, 0], y, 1), x[:, 0])) ** 2) / y.var())
    assert told["residual_r2"] > 0.9 and told["overlap"] < 0.1
    assert out.where(F.abs(F.col("total") - F.col("linear") - F.col("residual_alpha")) > 1e-12).count() == 0


def test_signals_spread_date_by_date(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 3.0), (3, 2, 3.0)], "ticker long, other long, weight double")
    days = {"x": [1.0, 0.0, 0.0], "y": [0.0, 2.0, -1.0]}
    signal = spark.createDataFrame([(d, k + 1, v) for d, vs in days.items() for k, v in enumerate(vs)], "day string, ticker long, value double")
    got = {(r["day"], r["ticker"]): r["value"] for r in A.propagated(edges, signal, by=["day"]).collect()}
    for d in days:
        alone = {r["ticker"]: r["value"] for r in A.propagated(edges, signal.where(F.col("day") == d)).collect()}
        assert alone == {t: v for (e, t), v in got.items() if e == d}


def test_shared_bars_are_the_same_bars(spark):
    seen = []

    @V.bars_once
    def plan(spark, d):
        seen.extend([V.bars(spark, d), V.bars(spark, d), V.returns(spark, d)])
        return seen[0]

    bars, own = plan(spark, SF), V.bars(spark, SF)
    assert bars.columns == own.columns and bars.exceptAll(own).count() == 0 == own.exceptAll(bars).count()
    assert seen[2].drop("ret").exceptAll(own).count() == 0
    assert "lineitem" not in bars._jdf.queryExecution().toString()
    assert "lineitem" in V.bars(spark, SF)._jdf.queryExecution().toString()  # nothing stays shared afterwards
