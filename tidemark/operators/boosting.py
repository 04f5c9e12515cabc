"""Boosted trees under constraints, grown from aggregates; and what each feature adds to a prediction.

Rows are binned once, and rows with equal bins are one cell from then on: a tree can't tell them
apart, and squared error needs no more of them than their number and the sum of what is left. A level
of a tree is one aggregation of the cells by node, feature and bin: a table whose size the tree's shape bounds,
whatever the rows. Splits are chosen from it on the driver; predictions and residuals are column
expressions over the trees' arrays, so rows never leave the executors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import dropped, written

#: Trees after which residuals are written anew, so that lineages stay short.
KEEP = 5


@dataclass
class Tree:
    """A full binary tree of ``depth`` levels as arrays over its nodes; node k has 2k + 1 and 2k + 2 below it.

    ``feature`` is -1 where a node does not split; rows go right if their bin is above
    ``cut``. ``value`` and ``cover`` (rows that reached it) are given for all nodes.
    """

    depth: int
    feature: list[int]
    cut: list[int]
    value: list[float]
    cover: list[float]
    gain: list[float]


@dataclass
class Model:
    """``edges`` part each feature's values into bins; a prediction is ``base`` and the values of the nodes that a row ends in."""

    features: list[str]
    edges: list[list[float]]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)


def binned(model: Model) -> Column:
    """The bins of a row's features: how many edges lie below each value; null is below all."""

    def below(feature: str, edges: list[float]) -> Column:
        return F.coalesce(F.size(F.filter(_literal(edges, "double"), lambda e: e < F.col(feature))), F.lit(0)) if edges else F.lit(0)

    return F.array(*[F.when(F.col(f).isNull(), 0).otherwise(below(f, e)) for f, e in zip(model.features, model.edges, strict=True)])


def _literal(values: list, kind: str) -> Column:
    return F.lit(values).cast(f"array<{kind}>")


def _node(tree: Tree, levels: int, bins: Column) -> Column:
    """The node that a row is in after ``levels``; it stays where a node does not split."""
    return _ends(tree, levels, bins, list(range(len(tree.feature))))


def _ends(tree: Tree, levels: int, bins: Column, values: list, at: int = 0) -> Column:
    """What ``values`` gives for the node that a row is in ``levels`` below ``at``: a compiled CASE for each split, no lambda over the levels."""
    if not levels or tree.feature[at] < 0:
        return F.lit(values[at])
    left, right = (_ends(tree, levels - 1, bins, values, child) for child in (2 * at + 1, 2 * at + 2))
    return F.when(F.get(bins, F.lit(tree.feature[at])) > tree.cut[at], right).otherwise(left)


def output(tree: Tree, bins: Column) -> Column:
    """The value of the node that a row ends in."""
    return _ends(tree, tree.depth, bins, [float(v) for v in tree.value])


def _split(sums: np.ndarray, counts: np.ndarray, allowed: set[int], signs: list[int], low: float, high: float, least: int, ridge: float) -> tuple | None:
    """The best (gain, feature, cut, left value, right value) of a node by its sums and counts (feature, bin); None where nothing gains.

    Values are held between the node's bounds; a split against a feature's sign is no split.
    """
    best = None
    for f in sorted(allowed):
        total, n = sums[f].sum(), counts[f].sum()
        whole = total * total / (n + ridge)
        ls, ln = np.cumsum(sums[f])[:-1], np.cumsum(counts[f])[:-1]
        rs, rn = total - ls, n - ln
        fits = (ln >= least) & (rn >= least)
        left, right = np.clip(ls / (ln + ridge), low, high), np.clip(rs / (rn + ridge), low, high)
        fits &= (right - left) * signs[f] >= 0
        # what held values gain over the node's own: 2 s v - (n + ridge) v^2 on each side
        gain = np.where(fits, 2 * ls * left - (ln + ridge) * left**2 + 2 * rs * right - (rn + ridge) * right**2 - whole, -np.inf)
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > 1e-12 and (best is None or gain[k] > best[0] + 1e-12):
            best = (float(gain[k]), f, k, float(left[k]), float(right[k]))
    return best


def fit(
    rows: DataFrame, y: str, features: list[str], monotone: dict[str, int] | None = None, groups: list[list[str]] | None = None,
    rounds: int = 10, depth: int = 3, bins: int = 32, rate: float = 0.1, least: int = 20, ridge: float = 1.0,
) -> Model:
    """Trees for ``y`` by squared error, each fitted to what the ones before leave.

    ``monotone`` gives features a sign: predictions never fall (1) or rise (-1) along them,
    since both sides of a split on them are kept on their sides of its middle all the way
    down. Features of one path all belong to one of ``groups``; a feature in no group
    stands alone. Rows with a null y are left out; a null feature is below all values. No
    rows give a model that predicts 0.
    """
    known = rows.where(F.col(y).isNotNull())
    shares = [k / bins for k in range(1, bins)]
    told = known.agg(F.avg(y).alias("base"), *[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"q{k}") for k, f in enumerate(features)]).first()
    model = Model(features, [sorted(set(told[f"q{k}"] or [])) for k in range(len(features))], told["base"] or 0.0)
    if told["base"] is None:
        return model
    signs = [(monotone or {}).get(f, 0) for f in features]
    named = groups or [features]
    places = [{features.index(f) for f in g if f in features} for g in named] + [{k} for k, f in enumerate(features) if not any(f in g for g in named)]
    each = known.select(binned(model).alias("bins"), (F.col(y) - model.base).cast("double").alias("rest"))
    held = written(each.groupBy("bins").agg(F.sum("rest").alias("rest"), F.count(F.lit(1)).alias("n")), "boosted")
    table = held
    width = max(len(e) for e in model.edges) + 1
    size = 2 ** (depth + 1) - 1
    for turn in range(rounds):
        tree = Tree(depth, [-1] * size, [0] * size, [0.0] * size, [0.0] * size, [0.0] * size)
        bounds, paths = {0: (-math.inf, math.inf)}, {0: set()}
        for level in range(depth):
            at = _node(tree, level, F.col("bins"))
            each = held.select(at.alias("node"), "rest", "n", F.posexplode("bins").alias("feature", "bin"))
            found = each.where(F.col("node") >= 2**level - 1).groupBy("node", "feature", "bin").agg(F.sum("rest").alias("s"), F.sum("n").alias("n")).collect()
            sums, counts = {}, {}
            for r in found:
                sums.setdefault(r["node"], np.zeros((len(features), width)))[r["feature"], r["bin"]] = r["s"]
                counts.setdefault(r["node"], np.zeros((len(features), width)))[r["feature"], r["bin"]] = r["n"]
            for node in sorted(sums):
                tree.cover[node] = float(counts[node][0].sum())
                if node == 0:
                    tree.value[0] = float(sums[0][0].sum() / (tree.cover[0] + ridge))
                allowed = set().union(*[g for g in places if paths[node] <= g])
                low, high = bounds[node]
                best = _split(sums[node], counts[node], allowed, signs, low, high, least, ridge)
                if best is None:
                    continue
                tree.gain[node], f, tree.cut[node], left, right = best
                tree.feature[node] = f
                middle = (left + right) / 2
                for child, value, mine in ((2 * node + 1, left, (low, middle)), (2 * node + 2, right, (middle, high))):
                    tree.value[child] = value
                    paths[child] = paths[node] | {f}
                    bounds[child] = (low, high) if not signs[f] else mine if signs[f] > 0 else ((middle, high) if mine[0] == low else (low, middle))
                side = counts[node][f]
                tree.cover[2 * node + 1] = float(side[: tree.cut[node] + 1].sum())
                tree.cover[2 * node + 2] = float(side[tree.cut[node] + 1 :].sum())
        if tree.feature[0] < 0:
            break
        tree.value = [v * rate for v in tree.value]
        model.trees.append(tree)
        held = held.withColumn("rest", F.col("rest") - F.col("n") * output(tree, F.col("bins")))
        if turn % KEEP == KEEP - 1 and turn + 1 < rounds:
            before, table = table, written(held, "boosted")
            held = table
            dropped(before)
    dropped(table)
    return model


def predicted(rows: DataFrame, model: Model, name: str = "prediction") -> DataFrame:
    """``rows`` with the model's prediction."""
    held = rows.withColumn("_bins", binned(model))
    return held.withColumn(name, sum((output(t, F.col("_bins")) for t in model.trees), F.lit(float(model.base)))).drop("_bins")


def importance(model: Model) -> list[tuple[str, float, int]]:
    """(feature, gain, splits) of each feature."""
    return [(name, sum(g for t in model.trees for f, g in zip(t.feature, t.gain, strict=True) if f == k), sum(f == k for t in model.trees for f in t.feature)) for k, name in enumerate(model.features)]


def _leaves(tree: Tree) -> Iterator[tuple[float, dict[int, tuple[int, int, float]]]]:
    """Each leaf's value and, for each feature on its path, the least and greatest bin that leads there and the share of rows that would."""
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = tree.feature[node]
        if f < 0:
            yield tree.value[node], path
            continue
        low, high, share = path.get(f, (-1, 1 << 30, 1.0))
        for child, a, b in ((2 * node + 1, low, min(high, tree.cut[node])), (2 * node + 2, max(low, tree.cut[node] + 1), high)):
            stack.append((child, path | {f: (a, b, share * tree.cover[child] / tree.cover[node])}))


def contributions(bins: np.ndarray, model: Model) -> tuple[float, np.ndarray]:
    """The mean prediction over the trees' own covers, and for rows of ``bins`` each feature's Shapley value.

    A feature that is left out goes down both sides of its splits by their covers. A
    leaf's value is shared among the few features on its path, subset by subset, for all
    rows at once; the contributions and the mean add up to the prediction.
    """
    out, mean = np.zeros((len(bins), len(model.features))), model.base
    for tree in model.trees:
        for value, path in _leaves(tree):
            names = sorted(path)
            inside = {f: ((bins[:, f] >= path[f][0]) & (bins[:, f] <= path[f][1])).astype(float) for f in names}
            share = {f: path[f][2] for f in names}
            mean += value * math.prod(share.values())
            for f in names:
                rest = [g for g in names if g != f]
                weight = np.zeros(len(bins))
                for n in range(len(rest) + 1):
                    part = math.factorial(n) * math.factorial(len(rest) - n) / math.factorial(len(names))
                    for some in itertools.combinations(rest, n):
                        term = np.full(len(bins), part)
                        for g in rest:
                            term *= inside[g] if g in some else share[g]
                        weight += term
                out[:, f] += value * weight * (inside[f] - share[f])
    return mean, out


def attributed(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys, base, by_<feature> of each feature and prediction: the contributions and their sum."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"by_{f}" for f in model.features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.stack(batch.column("_bins").to_numpy(zero_copy_only=False))
            base, parts = contributions(bins, model)
            columns = [*[batch.column(k) for k in keys], pa.array(np.full(len(bins), base)), *[pa.array(parts[:, k]) for k in range(len(names))], pa.array(base + parts.sum(axis=1))]
            yield pa.record_batch(columns, [*keys, "base", *names, "prediction"])

    held = rows.select(*keys, binned(model).alias("_bins"))
    return held.mapInArrow(run, f"{kinds}, base double, {', '.join(f'{n} double' for n in names)}, prediction double")
