"""Constrained trees against numpy, Shapley values against subsets, and scores against their factors."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from tidemark.operators import boosting as T
from tidemark.operators import learning as L


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(5)
    x = np.round(draw.uniform(-3, 3, (600, 4)), 2)
    y = 0.5 * x[:, 0] + np.sin(2 * x[:, 1]) - 0.3 * x[:, 2] * (x[:, 0] > 0) + draw.normal(0, 0.5, 600)
    rows = [(k, *map(float, r), float(v), "x") for k, (r, v) in enumerate(zip(x, y, strict=True))]
    rows[7] = (7, None, 1.0, None, 2.0, 0.1, "x")
    rows[8] = (8, 1.0, 1.0, 1.0, 1.0, None, "x")
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, bins string").repartition(4)


def grown(bins, y, signs, places, rounds, depth, rate, least, ridge):
    """The same boosting over arrays, node by node; the predictions of all rows."""
    base = y.mean()
    rest, out = y - base, np.full(len(y), base)
    for _ in range(rounds):
        step = np.zeros(len(y))
        todo = [(np.arange(len(y)), 0, set(), -math.inf, math.inf, rest.sum() / (len(y) + ridge))]
        while todo:
            at, level, path, low, high, value = todo.pop()
            best = None
            allowed = sorted(set().union(*[g for g in places if path <= g])) if level < depth else []
            total, n = rest[at].sum(), len(at)
            for f in allowed:
                for cut in range(bins[:, f].max()):
                    left = bins[at, f] <= cut
                    ln = left.sum()
                    if ln < least or n - ln < least:
                        continue
                    ls = rest[at][left].sum()
                    rs = total - ls
                    lv, rv = np.clip(ls / (ln + ridge), low, high), np.clip(rs / (n - ln + ridge), low, high)
                    if (rv - lv) * signs[f] < 0:
                        continue
                    gain = 2 * ls * lv - (ln + ridge) * lv**2 + 2 * rs * rv - (n - ln + ridge) * rv**2 - total**2 / (n + ridge)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, cut, lv, rv)
            if best is None:
                step[at] = value * rate
                continue
            _, f, cut, lv, rv = best
            middle = (lv + rv) / 2
            left = bins[at, f] <= cut
            lows = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
            todo += [(at[left], level + 1, path | {f}, *lows[0], lv), (at[~left], level + 1, path | {f}, *lows[1], rv)]
        out, rest = out + step, rest - step
    return out


@pytest.mark.parametrize(("monotone", "groups"), [({}, None), ({"a": 1, "c": -1}, None), ({"a": 1}, [["a", "c"], ["b"]])])
def test_trees_against_numpy(table, monotone, groups):
    model = T.fit(table, "y", ["a", "b", "c", "d"], monotone, groups, rounds=4, depth=3, bins=16)
    rows = sorted(T.predicted(table.withColumn("_b", T.binned(model)), model).collect(), key=lambda r: r.id)
    known = [r for r in rows if r.y is not None]
    bins = np.array([r._b for r in known])
    signs = [monotone.get(f, 0) for f in "abcd"]
    places = [{"abcd".index(f) for f in g} for g in groups] + [{3}] if groups else [{0, 1, 2, 3}]
    want = grown(bins, np.array([r.y for r in known]), signs, places, 4, 3, 0.1, 20, 1.0)
    assert np.allclose([r.prediction for r in known], want, atol=1e-9)
    assert len(model.trees) == 4 and rows[8].prediction is not None
    for tree in model.trees:  # features that may not meet don't
        for _, path in T._leaves(tree):
            assert any(set(path) <= g for g in places)


def test_predictions_follow_the_signs(spark, table):
    model = T.fit(table, "y", ["a", "b", "c", "d"], {"a": 1, "c": -1}, rounds=6, depth=3)
    draw = np.random.default_rng(1)
    base = draw.uniform(-3, 3, (50, 4))
    for f, sign in ((0, 1), (2, -1)):
        rows = [(k, j, *[float(v if m != f else x) for m, v in enumerate(base[k])]) for k in range(50) for j, x in enumerate(np.linspace(-3.5, 3.5, 30))]
        got = T.predicted(spark.createDataFrame(rows, "k int, j int, a double, b double, c double, d double"), model).collect()
        values = np.full((50, 30), np.nan)
        for r in got:
            values[r.k, r.j] = r.prediction
        assert (np.diff(values, axis=1) * sign >= -1e-12).all()
        assert np.ptp(values, axis=1).max() > 0.1


def test_contributions_against_subsets(table):
    model = T.fit(table, "y", ["a", "b", "c", "d"], {"a": 1}, rounds=3, depth=3, bins=8)
    rows = T.attributed(table, model, ["id"]).collect()
    held = {r.id: r for r in T.predicted(table.withColumn("_b", T.binned(model)), model).collect()}

    def value(bins, some):
        """The prediction where only the features ``some`` are known."""
        def down(tree, node):
            f = tree.feature[node]
            if f < 0:
                return tree.value[node]
            if f in some:
                return down(tree, 2 * node + 1 + (bins[f] > tree.cut[node]))
            return sum(tree.cover[c] * down(tree, c) for c in (2 * node + 1, 2 * node + 2)) / tree.cover[node]

        return model.base + sum(down(t, 0) for t in model.trees)

    for r in rows[:40]:
        bins = held[r.id]._b
        for f, name in enumerate("abcd"):
            rest = [g for g in range(4) if g != f]
            want = sum(
                math.factorial(n) * math.factorial(3 - n) / 24 * (value(bins, {*some, f}) - value(bins, set(some))) for n in range(4) for some in itertools.combinations(rest, n)
            )
            assert r[f"by_{name}"] == pytest.approx(want, abs=1e-12)
        assert r.base == pytest.approx(value(bins, set()))
    assert all(r.prediction == pytest.approx(held[r.id].prediction) for r in rows)
    gains = {f: (g, n) for f, g, n in T.importance(model)}
    assert gains["b"][0] > gains["d"][0] and sum(n for _, n in gains.values()) > 4


def test_trees_of_nothing(table):
    model = T.fit(table.where("false"), "y", ["a", "b"])
    assert {r.prediction for r in T.predicted(table, model).collect()} == {0.0}
    one = T.fit(table.where("id = 1"), "y", ["a", "b"])
    assert not one.trees and T.attributed(table.where("false"), one, ["id"]).count() == 0


def test_scores_are_orthogonal_to_factors(spark):
    draw = np.random.default_rng(2)
    f = draw.normal(size=(500, 2))
    x = draw.normal(size=(500, 4)) * [1, 10, 0.01, 1] + (f @ draw.normal(size=(2, 4))) * [1, 10, 0.01, 1]
    y = x @ [1, 0.05, 3, -1] + f @ [2, -1] + draw.normal(size=500)
    rows = spark.createDataFrame([tuple(map(float, (*a, *b, c))) for a, b, c in zip(x, f, y, strict=True)] + [(None, *[1.0] * 6)], "x0 double, x1 double, x2 double, x3 double, f0 double, f1 double, y double")
    got, how = L.orthogonalised(rows, "y", ["x0", "x1", "x2", "x3"], ["f0", "f1"])
    alpha = np.array([r.alpha for r in got.where("alpha IS NOT NULL").collect()])
    assert len(alpha) == 500 and how["steps"] > 0 and not how["fallback"]
    for k in range(2):
        assert abs(np.corrcoef(alpha, f[:, k])[0, 1]) < 0.05
    assert np.corrcoef(alpha, y)[0, 1] > 0.2
    got, how = L.orthogonalised(rows, "y", ["x0", "x1", "x2", "x3"], ["f0", "f1"], steps=0)
    assert how["fallback"]
    alpha = np.array([r.alpha for r in got.where("alpha IS NOT NULL").collect()])
    assert max(abs(np.corrcoef(alpha, f[:, k])[0, 1]) for k in range(2)) < 0.05
    none, how = L.orthogonalised(rows.where("false"), "y", ["x0"], ["f0"])
    assert none.count() == 0 and how["weights"] == {"x0": 0.0}
