"""Work of plans that must not grow with a frame's length or a ticker's history squared, and that equals the plain form."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors as A
from tidemark.operators import quality as Q
from tidemark.functions.windows import ENDING, ROLLING, RUNNING, by_ticker, placed
from tidemark.plans import QUERIES
from tidemark.sources import views as V

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["f01_price_factor_panel", "f05_market_factor_panel", "f28_money_flow"])
def test_last_rows_without_year_frames(spark, name):
    """a year's frame is not summed anew for rows that no one reads."""
    told = plan(QUERIES[name](spark, SF))
    assert "RowFrame, -251" not in told and "RowFrame, -252" not in told


def test_last_row_equals_its_windows(spark):
    rows = V.returns(spark, "/root/testdata/sf0.01")
    wide = rows.select("ticker", "date", A.vol_scaled_total().alias("x"), A.amihud().alias("y"), A.momentum_6m().alias("z"))
    want = {r["ticker"]: r["r"] for r in wide.groupBy("ticker").agg(F.max(F.struct("date", "x", "y", "z")).alias("r")).collect()}
    got = placed(rows, 253).groupBy("ticker").agg(A.vol_scaled_total(ENDING).alias("x"), A.amihud(ENDING).alias("y"), A.momentum_6m(ENDING).alias("z")).collect()
    assert len(got) == len(want) > 0
    for r in got:
        for c in "xyz":
            assert (r[c] is None) == (want[r["ticker"]][c] is None)
            assert r[c] is None or abs(r[c] - want[r["ticker"]][c]) <= 1e-9 * max(1, abs(r[c]))


def test_interpolation_reads_no_frame_to_the_end(spark):
    """F14."""
    rows = spark.createDataFrame([(1, f"2000-01-0{k}", v, w) for k, (v, w) in enumerate([(None, 1.0), (2.0, None), (None, None), (None, 4.0), (8.0, None)], 1)], "ticker long, date string, a double, b double")
    out = Q.interpolated(rows, "a", "b")
    assert "unboundedfollowing" not in plan(out).lower()
    assert [(r["a"], r["b"]) for r in out.orderBy("date").collect()] == [(None, 1.0), (2.0, 2.0), (4.0, 3.0), (6.0, 4.0), (8.0, None)]


def test_regimes_are_fitted_side_by_side(monkeypatch):
    """Many series cost the steps of one, and give what each gives alone."""
    import numpy as np

    from tidemark.operators import regimes as H

    x = np.random.default_rng(3).normal(0, 0.1, (64, 60))
    alone = [H.fitted(v) for v in x]
    passes, smooth = [], H._smoothed
    monkeypatch.setattr(H, "_smoothed", lambda *a: passes.append(1) or smooth(*a))
    many = H._fitted(x)
    assert len(passes) == max(c.rounds for c in alone)
    assert all(np.allclose(c.mean, many.mean[k]) and c.rounds == many.rounds[k] for k, c in enumerate(alone))
    assert all((H.decoded(v, c) == p).all() for v, c, p in zip(x, alone, H._decoded(x, many), strict=True))


def test_divergence_makes_no_array_calls(monkeypatch):
    """what is done at each value of a stream equals numpy's counts without calling it."""
    import numpy as np

    from tidemark.streaming import regimes as G

    for errors in (tuple(np.random.default_rng(k).normal(0, 1, 20)) for k in range(50)):
        edges = np.linspace(min(errors) - 1e-10, max(errors) + 1e-10, 11)
        old, new = (np.histogram(p, edges)[0] + 1e-10 for p in (errors[:10], errors[10:]))
        want = np.sum(old / old.sum() * np.log(old / old.sum() / (new / new.sum())))
        with monkeypatch.context() as m:
            m.setattr(np, "histogram", None)
            assert abs(G.divergence(errors) - want) < 1e-9


def test_orthogonal_alpha_sums_no_long_frames(spark, monkeypatch):
    """the frames that l07 checkpoints are running sums."""
    from tidemark.plans import strategy

    told = []
    monkeypatch.setattr(strategy, "checkpointed", lambda df: told.append(plan(df)) or df)
    QUERIES["l07_orthogonal_alpha"](spark, SF)
    assert told and not any(f in t for t in told for f in ("covar_samp", "stddev_samp", "var_samp", "avg(close"))


def test_transcripts_make_no_row_for_a_word(spark, capsys):
    """Chunks of 400 words, as a plain loop scores them, are rows of two numbers; a doc_id's rows are one text."""
    from tidemark.operators import valuation as N

    rng = np.random.default_rng(3)
    some = ["Beats", "loss", "the", "", "Low\nER", "ups", *("x" * k for k in range(1, 9))]
    texts = [" ".join(rng.choice(some, n)) for n in (0, 1, 399, 400, 401, 1300)]
    rows = [*enumerate(texts), (6, None), (7, ""), (1, texts[5]), (None, "up")]
    parts = {}
    for i, text in rows:
        words = [] if text is None else text.split(" ")
        for k in range(0, len(words), 400):
            parts.setdefault((i, k), []).append(" ".join(words[k : k + 400]).lower())
    want = {}
    for (i, _), chunk in parts.items():
        up, down = (sum(any(w in t for t in chunk) for w in words) for words in (N.LIFT, N.LOWER))
        want.setdefault(i, []).append((up - down) / (up + down + 1))
    out = N.transcript_sentiment(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.chunks, round(r.sentiment, 9)) for r in out.collect()} == {i: (len(x), round(sum(x) / len(x), 9)) for i, x in want.items()}
    out.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_divergences_read_what_swings_are_found_from_once(spark):
    rows = spark.createDataFrame([(1, k, float(h), float(lo), float(i), h > 0, lo > 0) for k, (h, lo, i) in enumerate([(9, 0, 5), (0, 3, 2), (8, 2, 4), (9.5, 0, 3)])], "ticker int, date int, high double, low double, mfi double, swing_high boolean, swing_low boolean")
    out = A.divergences(rows, "mfi")
    assert {(r.ticker, r.kind, r.confidence) for r in out.collect()} == {(1, "bullish", 1.0), (1, "bearish", 1.0)}
    assert plan(out).count("LogicalRDD") + plan(out).count("LocalRelation") == 1


def test_shared_bars_know_how_they_lie(spark):
    """windows by ticker over shared bars neither shuffle nor sort."""

    @V.bars_once
    def lagged(spark, d):
        return V.returns(spark, d).select("ticker", F.lag("close").over(by_ticker()).alias("was"))

    told = lagged(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in told and "Sort [" not in told


def test_trees_grow_from_cells(spark, monkeypatch):
    """what a tree's levels read is bounded by bins, not by rows."""
    from tidemark.operators import boosting as T

    sizes, keep = [], T.written
    monkeypatch.setattr(T, "written", lambda df, name: sizes.append(df.count()) or keep(df, name))
    rows = spark.range(4000).select((F.col("id") % 5).cast("double").alias("x"), ((F.col("id") % 5) * 2 + F.col("id") % 3).cast("double").alias("y"))
    model = T.fit(rows, "y", ["x"], rounds=2, depth=2)
    assert sizes == [5] and len(model.trees) == 2
    assert [t.cover[0] for t in model.trees] == [4000.0, 4000.0]


def test_signals_of_many_days_share_an_edge(spark):
    """an edge is met once for a block of days; nulls, absent names and repeated rows give what each day gives alone."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 3.0), (3, 2, 3.0)], "ticker long, other long, weight double")
    signal = [(d, t, None if (d + t) % 5 == 0 else float(d * t)) for d in range(30) for t in (1, 2, 3) if (d, t) != (7, 2)] + [(4, 1, 9.0)]
    rows = spark.createDataFrame(signal, "day int, ticker long, value double")
    out = A.propagated(edges, rows, by=["day"])
    got = sorted((r["day"], r["ticker"], r["value"] is not None, r["value"] or 0.0) for r in out.collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted((d, t, v is not None, v or 0.0) for d, t, v in signal)]
    for d in (0, 4, 7, 29):
        alone = sorted(r["value"] for r in A.propagated(edges, rows.where(F.col("day") == d)).collect() if r["value"] is not None)
        assert sorted(v for day, _, known, v in got if day == d and known) == pytest.approx(alone)


def test_running_sums_equal_frames(spark):
    """F18, F22."""
    rets = V.returns(spark, "/root/testdata/sf0.01")
    rows = rets.join(F.broadcast(V.market(rets)), "date", "left")
    factors = [A.betting_against_beta, lambda at: A.betting_against_beta(True, at), A.volatility_60d, A.amihud, lambda at: A.levy(60, at), A.vol_scaled_total, A.vol_targeted_momentum]
    columns = [f(at).alias(f"c{j}{k}") for j, f in enumerate(factors) for k, at in enumerate((ROLLING, RUNNING))]
    met = 0
    for r in rows.select(*columns).where("c00 IS NOT NULL OR c20 IS NOT NULL").collect():
        for j in range(len(factors)):
            a, b = r[f"c{j}0"], r[f"c{j}1"]
            assert (a is None) == (b is None)
            met += a is not None
            assert a is None or abs(a - b) <= 1e-8 * max(1, abs(a))
    assert met > 1000


def test_universes_meet_bars_without_copies(spark):
    """bars are not repeated for each month that a date can reach back to."""
    from tidemark.operators import optimiser as O

    universes = spark.sql("select date'2000-03-31' as as_of, 1L as ticker")
    days = [("2000-03-31", 5.0), ("2000-03-31", 6.0), ("1999-04-02", 2.0), ("1999-04-01", 1.0), ("2000-04-01", 9.0), ("1999-12-15", None)]
    bars = spark.createDataFrame([(1, d, c) for d, c in days], "ticker long, date string, close double").withColumn("date", F.to_date("date"))
    out = O.histories(universes, bars)
    assert "sequence(((year(_date" not in plan(out).lower() and "sequence(((year(date" not in plan(out).lower()
    assert [(str(c["date"]), c["close"]) for c in out.collect()[0]["closes"]] == [("1999-04-02", 2.0), ("2000-03-31", 6.0)]


def test_barriers_make_no_lists(spark):
    """F22."""
    rows = spark.createDataFrame([(1, k, c, r) for k, (c, r) in enumerate([(10.0, None), (11.0, 0.1), (10.0, -0.1), (None, None), (15.0, 0.2), (15.0, 0.0)])], "ticker long, date int, close double, ret double")
    out = A.triple_barrier(rows, horizon=3, span=2)
    assert "collect_list" not in plan(out)
    assert [(r["date"], r["label"], r["touched"], r["ret"]) for r in out.orderBy("date").collect()] == [(2, 1, 4, 0.5)]


def test_snapshots_share_one_panel(spark, monkeypatch):
    """the panel is not worked out anew for each table that a snapshot writes."""
    from tidemark.plans import lake as plans

    told, keep = [], plans.lake.write_snapshot
    monkeypatch.setattr(plans.lake, "write_snapshot", lambda rows, *a, **k: told.append(plan(rows)) or keep(rows, *a, **k))
    plans.sc14_snapshots(spark, SF)
    assert len(told) == 2 and not any("Window" in t for t in told)


def test_edges_move_once_in_cells(spark, monkeypatch):
    """F3 of round 4: signals come back from cells of edges, many ids, weights and edges met twice included; edges and signals are not joined."""
    cells, pack = [], A._packed
    monkeypatch.setattr(A, "AT_ONCE", 7)
    monkeypatch.setattr(A, "_packed", lambda *a: cells.append(pack(*a)) or cells[-1])
    draw = np.random.default_rng(11)
    ids = [int(x) for x in draw.choice(10**12, 40, replace=False)]
    edges = [(ids[a], ids[b], float(w)) for a, b, w in zip(draw.integers(0, 40, 300), draw.integers(0, 40, 300), draw.integers(1, 4, 300), strict=True)] + [(None, ids[0], 1.0), (ids[0], None, 1.0), (5, ids[1], 2.0)]
    for graph in (edges, [(a, b, 1.0) for a, b, _ in edges]):
        held = spark.createDataFrame(graph, "ticker long, other long, weight double")
        rows = spark.createDataFrame([(d, t, float(draw.normal())) for d in range(14) for t in ids if (t + d) % 6], "day int, ticker long, value double")
        out = A.propagated(held, rows, by=["day"])
        assert cells.pop().count() <= A.GROUPS**2 and not cells  # for both rounds
        got = {(r["day"], r["ticker"]): r["value"] for r in out.collect()}
        assert len(got) == rows.count()
        for d in (0, 13):
            alone = {r["ticker"]: r["value"] for r in A.propagated(held, rows.where(F.col("day") == d)).collect()}
            assert {t: v for (e, t), v in got.items() if e == d} == pytest.approx(alone)
    assert A.propagated(held.limit(0), rows, by=["day"]).exceptAll(rows).count() == 0 == A.propagated(held, rows.limit(0), by=["day"]).count()


def test_meetings_are_the_edges_from_both_ends(spark):
    """F3 of round 4: and four columns of shared bars give what all of them give."""
    from tidemark.operators import relational as R

    edges, met = R.both_ways(V.edges(spark, SF)), V.meetings(spark, SF).groupBy("ticker", "other").agg(F.sum("weight").alias("weight"))
    assert met.exceptAll(edges).count() == 0 == edges.exceptAll(met).count() and edges.count() > 0
    close = V.closes_once(lambda spark, d: V.returns(spark, d))(spark, SF)
    own = V.returns(spark, SF).select("ticker", "date", "close", "ret")
    assert close.columns == own.columns and close.exceptAll(own).count() == 0 == own.exceptAll(close).count()
