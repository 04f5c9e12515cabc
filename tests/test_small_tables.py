"""Small tables: errors, edges and the folds that SQL does not express."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import quality as Q
from tidemark.operators import relational as R
from tidemark.operators import scoring as S
from tidemark.sources import lake


def bars(spark, rows):
    return spark.createDataFrame(rows, "ticker long, date date, open double, high double, low double, close double, adj_close double, volume double")


def day(k):
    return date(2024, 1, k)


def test_features_need_no_circle_and_known_names():
    f = S.Features()
    f.register("a", needs=("b",))(lambda: F.lit(1.0))
    with pytest.raises(ValueError, match="unknown feature b"):
        f.levels()
    f.register("b", needs=("a",))(lambda: F.lit(1.0))
    with pytest.raises(ValueError, match="need each other"):
        f.levels()
    with pytest.raises(ValueError, match="registered already"):
        f.register("a")(lambda: F.lit(2.0))


def test_features_above_a_missing_column_are_null(spark):
    f = S.Features()
    f.register("top", needs=("gone",))(lambda: F.col("gone") + 1)
    f.register("gone")(lambda: F.col("no_such_column") * 2)
    f.register("own")(lambda: F.col("x") * 2)
    assert f.levels(["own"]) == {"own": 0}
    got = f.computed(spark.createDataFrame([(1, 2.0)], "ticker long, x double")).collect()
    assert [(r["gone"], r["top"], r["own"]) for r in got] == [(None, None, 4.0)]


def test_weights_are_checked(spark):
    with pytest.raises(ValueError, match="nothing"):
        S.effective_weights(spark, {"nothing": 1.0})
    with pytest.raises(ValueError, match="quality"):
        S.effective_weights(spark, {"quality": -1.0})
    assert S.effective_weights(spark, off=("value",)).where("factor = 'value' AND weight <> 0").count() == 0


def test_looking_ahead_stops_the_job(spark):
    rows = spark.createDataFrame([(day(3), day(2)), (day(1), day(2))], "as_of date, target date")
    assert R.asserted(rows.where("as_of <= target"), "as_of", "target").count() == 1
    with pytest.raises(PySparkException, match="2024-01-03"):
        R.asserted(rows, "as_of", "target").collect()


def test_mending_keeps_ends_and_bridges_the_middle(spark):
    rows = bars(spark, [(1, day(k), 5.0, 6.0, 1.0, c, c, v) for k, c, v in ((1, 0.0, 10.0), (2, 2.0, None), (3, 0.0, 30.0), (4, -1.0, None), (5, 5.0, 50.0), (6, 0.0, 60.0))] + [(2, day(1), 5.0, 6.0, 1.0, 0.0, 0.0, None)])
    issues = Q.row_issues(rows).where("issue IN ('price_not_positive', 'volume_not_positive')")
    issues = issues.withColumn("action", F.when(F.col("issue") == "price_not_positive", "interpolate").otherwise("ffill"))
    got = {(r["ticker"], r["date"].day): (r["close"], r["volume"]) for r in Q.filled_in(rows, issues).collect()}
    assert got == {(1, 1): (0.0, 10.0), (1, 2): (2.0, 10.0), (1, 3): (3.0, 30.0), (1, 4): (4.0, 30.0), (1, 5): (5.0, 50.0), (1, 6): (0.0, 60.0), (2, 1): (0.0, None)}


def test_a_failing_ticker_stops_no_other(spark):
    rows = bars(spark, [(t, day(k), 5.0, 6.0, 4.0, None if t == 2 and k == 2 else 5.0, 5.0, 0.0 if k == 3 else 9.0) for t in (1, 2) for k in range(1, 5)])
    clean, report = Q.caught_up(rows)
    assert {tuple(r) for r in report.select("ticker", "status", "added", "dropped").collect()} == {(1, "updated", 3, 1), (2, "failed", 0, 0)}
    assert {r["ticker"] for r in clean.collect()} == {1}
    assert Q.caught_up(rows.limit(0))[1].count() == 0


def test_versions_are_written_once(spark, tmp_path):
    rows = spark.range(3)
    lake.write_version(rows, str(tmp_path), "ids", "1")
    with pytest.raises(PySparkException):
        lake.write_version(rows, str(tmp_path), "ids", "1")
    assert lake.catalogue(spark, str(tmp_path)).count() == 1


def test_greedy_selection_against_a_fold(spark):
    scores = [(day(k), t, "ab"[t % 2], ((t * 7 + k * 3) % 11) / 10) for k in (1, 2, 3) for t in range(1, 12)]
    got = B.greedy(spark.createDataFrame(scores, "as_of date, ticker long, sector string, score double"), "as_of", 4, 0.5)
    held, want = set(), set()
    for k in (1, 2, 3):
        today = sorted((-s, t, c) for d, t, c, s in scores if d == day(k))[:8]
        ordered = [x for x in today if x[1] in held] + [x for x in today if x[1] not in held]
        picked = []
        for _, t, c in ordered:
            if len(picked) < 4 and sum(x == c for _, x in picked) < 2:
                picked.append((t, c))
        held = {t for t, _ in picked}
        want |= {(day(k), t, 1 / len(held)) for t in held}
    assert {tuple(r) for r in got.drop("run").collect()} == want
