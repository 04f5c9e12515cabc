"""Registered features, factor weights, the ranking and the scorecard, over factors that other queries compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, finite, interp, norm_pdf, ratio, six
from tidemark.functions.windows import by_ticker, change, recent, rolling
from tidemark.operators import factors as A
from tidemark.operators import relational as R
from tidemark.operators import scoring as S
from tidemark.operators import xsec as X
from tidemark.plans import backtest, factors, valuation
from tidemark.plans.registry import SQL, query
from tidemark.plans.xsec import _PANEL, panel
from tidemark.sources import views as V

_W = "PARTITION BY ticker ORDER BY date"

FEATURES = S.Features()


@FEATURES.register("vol_20", needs=("ret_1",), category="volatility", lookback=20)
def _vol() -> Column:
    return rolling(F.stddev_samp, F.col("ret_1"), 20)


@FEATURES.register("ret_1", category="momentum", lookback=2)
def _ret() -> Column:
    return change(F.col("close"))


@FEATURES.register("sma_20", category="trend", lookback=20)
def _sma() -> Column:
    return rolling(F.avg, F.col("close"), 20)


@FEATURES.register("over_sma", needs=("sma_20",), category="trend", lookback=20)
def _over() -> Column:
    return ratio(F.col("close"), F.col("sma_20")) - 1


@FEATURES.register("steady_trend", needs=("over_sma", "vol_20"), category="trend", lookback=20)
def _steady() -> Column:
    return ratio(F.col("over_sma"), F.col("vol_20"))


@FEATURES.register("short_interest", category="alternative", lookback=1)
def _short() -> Column:
    """Of a column that bars don't have: null in every row."""
    return F.col("shares_short") / F.col("volume")


@query(f"""WITH {V.RETS}, a AS (SELECT ticker, date, close, ret, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS vol, close / nullif(CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END, 0) - 1 AS o,
row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM rets WINDOW w AS ({_W} ROWS 19 PRECEDING)) SELECT ticker, date, round(vol, 6) AS vol_20, round(o, 6) AS over_sma, round(o / nullif(vol, 0), 6) AS steady_trend, NULL::DOUBLE AS short_interest FROM a WHERE k = 1""")
def x08_registered_features(spark: SparkSession, d: str) -> DataFrame:
    """X08-X10, UD1 and UD4: the registered features of each ticker's last bar; one that can't be had is null."""
    rows = FEATURES.computed(V.bars(spark, d))
    last = R.latest(rows.select("ticker", "date", "vol_20", "over_sma", "steady_trend", "short_interest"), ["ticker"], "date")
    return last.select("ticker", "date", *[six(F.col(c)).alias(c) for c in ("vol_20", "over_sma", "steady_trend", "short_interest")])


@query(f"""WITH RECURSIVE {V.BARS}, hs AS (SELECT row_number() OVER ({_W}) AS k FROM bars), n AS (SELECT * FROM (VALUES ('vol_20', 'volatility', 20), ('ret_1', 'momentum', 2), ('sma_20', 'trend', 20), ('over_sma', 'trend', 20), ('steady_trend', 'trend', 20), ('short_interest', 'alternative', 1)) t(name, category, lookback)),
e AS (SELECT * FROM (VALUES ('vol_20', 'ret_1'), ('over_sma', 'sma_20'), ('steady_trend', 'over_sma'), ('steady_trend', 'vol_20')) t(name, needs)),
r AS (SELECT name, 0 AS level FROM n UNION ALL SELECT e.name, r.level + 1 FROM e JOIN r ON e.needs = r.name)
SELECT name, any_value(category) AS category, any_value(lookback)::INTEGER AS lookback, max(level)::INTEGER AS level, (SELECT count(*) FROM hs WHERE k >= any_value(lookback)) AS bars FROM n JOIN r USING (name) GROUP BY 1""")
def t06_feature_levels(spark: SparkSession, d: str) -> DataFrame:
    """The features' catalogue with the level at which each is computed, and how many bars have the history that it looks back on."""
    known = FEATURES.catalogue(spark)
    spans = [r["lookback"] for r in known.select("lookback").distinct().collect()]
    counts = V.bars(spark, d).select(F.row_number().over(by_ticker()).alias("k")).agg(*[F.count_if(F.col("k") >= n).alias(str(n)) for n in spans])
    return known.join(F.broadcast(counts.unpivot([], [str(n) for n in spans], "span", "bars")), F.col("lookback") == F.col("span").cast("int")).drop("span")


_WEIGHTS = (
    "w AS (SELECT regime, factor, category, CASE WHEN factor = 'volatility' THEN 0 WHEN factor = 'quality' THEN 1.2 ELSE base END * coalesce(times, 1) AS weight FROM (VALUES "
    + ", ".join(f"('{n}', '{c}', {w})" for n, (c, w) in S.FACTORS.items())
    + ") f(factor, category, base) CROSS JOIN (VALUES "
    + ", ".join(f"('{r}')" for r in S.MULTIPLIERS)
    + ") r(regime) LEFT JOIN (VALUES "
    + ", ".join(f"('{r}', '{n}', {x})" for r, m in S.MULTIPLIERS.items() for n, x in m.items())
    + ") m(regime, factor, times) USING (regime, factor))"
)


def _months(spark: SparkSession, d: str) -> DataFrame:
    """regime, months: how many month ends of the panel are in which regime."""
    mean = panel(spark, d).groupBy("as_of").agg(F.avg("mom").alias("mean"))
    return mean.groupBy(F.when(F.col("mean") > 0.02, "Bull").when(F.col("mean") < -0.02, "Bear").when(F.col("mean").isNull(), "Unknown").otherwise("Transition").alias("regime")).agg(F.count("*").alias("months"))


_MONTHS = f"""{_PANEL}, mn AS (SELECT CASE WHEN avg(mom) > 0.02 THEN 'Bull' WHEN avg(mom) < -0.02 THEN 'Bear' WHEN avg(mom) IS NULL THEN 'Unknown' ELSE 'Transition' END AS regime FROM panel GROUP BY as_of),
mt AS (SELECT regime, count(*) AS months FROM mn GROUP BY 1)"""


@query(f"WITH {_WEIGHTS}, ms AS (WITH {_MONTHS} SELECT regime, months FROM mt) SELECT w.regime, factor, category, round(weight::DOUBLE, 6) AS weight, coalesce(months, 0) AS months FROM w LEFT JOIN ms ON ms.regime = CASE w.regime WHEN 'Neutral' THEN 'Transition' ELSE w.regime END")
def x11_factor_weights(spark: SparkSession, d: str) -> DataFrame:
    """X11: quality at the user's weight, volatility switched off, under each regime, with the months that they apply to."""
    weights = S.effective_weights(spark, {"quality": 1.2}, ("volatility",)).withColumn("weight", six(F.col("weight")))
    months = _months(spark, d).withColumn("regime", F.when(F.col("regime") == "Transition", "Neutral").otherwise(F.col("regime")))
    return weights.join(F.broadcast(months), "regime", "left").fillna(0, ["months"])  # four rows


@query(f"""WITH {_WEIGHTS}, s AS ({SQL['f14_fundamental_scores']}), l AS (SELECT ticker, 'quality' AS factor, quality AS value FROM s UNION ALL SELECT ticker, 'value', value FROM s)
SELECT ticker, regime, round(sum(value * weight) / sum(weight), 6)::DOUBLE AS score FROM l JOIN w USING (factor) WHERE value IS NOT NULL AND weight > 0 GROUP BY 1, 2""")
def x11_weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Quality and value blended under every regime's weights in one pass."""
    narrow = valuation.f14_fundamental_scores(spark, d).unpivot(["ticker"], ["quality", "value"], "factor", "value")
    return S.composite(narrow, S.effective_weights(spark, {"quality": 1.2}, ("volatility",)), ["ticker"]).withColumn("score", six(F.col("score")))


@query(f"""WITH q AS ({SQL['h11_sector_quadrants']}), m AS ({SQL['f34_money_flow_score']}), {V.SECURITY}
SELECT ticker, sector, round(0.4 * coalesce(q.score, 0) + 0.6 * coalesce(m.score, 0), 6)::DOUBLE AS flow FROM security LEFT JOIN q USING (sector) LEFT JOIN m USING (ticker)""")
@V.bars_once
def f36_capital_flow(spark: SparkSession, d: str) -> DataFrame:
    """the sector's quadrant at 0.4 and the ticker's money flow at 0.6; 0 for what isn't there."""
    sectors = factors.h11_sector_quadrants(spark, d).select("sector", F.col("score").alias("q"))
    own = factors.f34_money_flow_score(spark, d).select("ticker", F.col("score").alias("m"))
    rows = V.security(spark, d).select("ticker", "sector").join(F.broadcast(sectors), "sector", "left").join(own, "ticker", "left")
    return rows.select("ticker", "sector", six(0.4 * F.coalesce("q", F.lit(0.0)) + 0.6 * F.coalesce("m", F.lit(0.0))).alias("flow"))


def _cases(values: dict[str, float], x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} = '{n}' THEN {v}" for n, v in values.items()) + " ELSE 0 END"


_CARD_PARTS = f"""q AS ({SQL['h11_sector_quadrants']}), mr AS ({SQL['f38_mansfield']}), vp AS ({SQL['f39_volume_structure']}), {V.BARS}, {V.SECURITY},
rl AS (SELECT ticker, close / nullif(CASE WHEN count(close) OVER w >= 130 THEN avg(close) OVER w END, 0) AS rsl, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WINDOW w AS ({_W} ROWS 129 PRECEDING)),
p AS (SELECT s.ticker, {_cases(S.QUADRANTS, 'q.quadrant')} AS rrg_position, (least(1, greatest(0, (rsl - 0.8) / 0.4)) * 100 - 50) / 50 AS rsl_rank,
{_cases(S.SIGNALS, "CASE WHEN mansfield IS NULL OR slope5 IS NULL THEN NULL WHEN mansfield > 0 AND slope5 > 0 THEN 'breakout' WHEN slope5 > 0 THEN 'improving' WHEN mansfield > 0 THEN 'weakening' ELSE 'lagging' END")} AS mrs_signal, {_cases(S.PATTERNS, 'v.pattern')} AS volume_pattern
FROM rl s JOIN security USING (ticker) LEFT JOIN q USING (sector) LEFT JOIN mr m ON m.ticker = s.ticker LEFT JOIN (SELECT ticker, arg_max(pattern, date) AS pattern FROM vp GROUP BY 1) v ON v.ticker = s.ticker WHERE k = 1)"""
_KNOWN = ["rrg_position", "rsl_rank", "mrs_signal", "volume_pattern"]
_SHARE = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {S.CARD[c]} END" for c in _KNOWN)
_TOTAL = " + ".join(f"{S.CARD[c]} * coalesce({c}, 0)" for c in _KNOWN)


@query(f"""WITH {_CARD_PARTS}, t AS (SELECT *, round(({_TOTAL}) / nullif({_SHARE}, 0), 6) AS s, {_SHARE} AS c FROM p)
SELECT ticker, coalesce(s, 0)::DOUBLE AS score, CASE WHEN coalesce(s, 0) > {S.BUY} THEN 'buy' WHEN coalesce(s, 0) < {S.SELL} THEN 'sell' ELSE 'hold' END AS signal, round(c, 6)::DOUBLE AS confidence, round(50 * rsl_rank + 50, 4)::DOUBLE AS percentile FROM t""")
@V.bars_once
def f40_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """quadrant, strength, its trend and the volume's pattern, weighted over those there are; earnings are reserved, so their weight is never there."""
    bars = V.bars(spark, d)
    strength = R.latest(recent(bars, 130).select("ticker", "date", A.levy().alias("rsl")), ["ticker"], "date").select("ticker", "rsl")
    trend = factors.f38_mansfield(spark, d)
    kind = F.when(F.col("mansfield").isNull() | F.col("slope5").isNull(), F.lit(None)).when((F.col("mansfield") > 0) & (F.col("slope5") > 0), "breakout")
    kind = kind.when(F.col("slope5") > 0, "improving").when(F.col("mansfield") > 0, "weakening").otherwise("lagging")
    volume = R.latest(recent(V.returns(spark, d), 20).select("ticker", "date", A.volume_structure()[1].alias("pattern")), ["ticker"], "date").select("ticker", "pattern")
    sectors = factors.h11_sector_quadrants(spark, d).select("sector", "quadrant")
    rows = strength.join(V.security(spark, d).select("ticker", "sector"), "ticker").join(F.broadcast(sectors), "sector", "left")
    rows = rows.join(trend.select("ticker", kind.alias("kind")), "ticker", "left").join(volume, "ticker", "left")
    percentile = interp(F.col("rsl"), 0.8, 1.2)
    rows = rows.select(
        "ticker", S.looked_up(S.QUADRANTS, F.col("quadrant")).alias("rrg_position"), ((percentile - 50) / 50).alias("rsl_rank"), percentile.alias("percentile"),
        S.looked_up(S.SIGNALS, F.col("kind")).alias("mrs_signal"), S.looked_up(S.PATTERNS, F.col("pattern")).alias("volume_pattern"),
    )
    share = sum((F.when(F.col(c).isNotNull(), S.CARD[c]).otherwise(0.0) for c in _KNOWN), F.lit(0.0))
    rows = rows.withColumn("score", six(X.weighted({c: S.CARD[c] for c in _KNOWN})))
    signal = F.when(F.col("score") > S.BUY, "buy").when(F.col("score") < S.SELL, "sell").otherwise("hold")
    return rows.select("ticker", "score", signal.alias("signal"), six(share).alias("confidence"), F.round("percentile", 4).alias("percentile"))


@query(f"""WITH {_MONTHS}, t AS (SELECT 'scorecard' AS weights, {len(S.CARD)} AS n, true AS complete {' '.join(f"UNION ALL SELECT '{r}', {len(w)}, {str(S.complete(w)).lower()}" for r, w in X.REGIME_WEIGHTS.items())})
SELECT weights, n, complete, coalesce(CASE WHEN weights = 'scorecard' THEN (SELECT sum(months)::BIGINT FROM mt) ELSE months END, 0) AS months FROM t LEFT JOIN mt ON regime = weights""")
def h12_complete_weights(spark: SparkSession, d: str) -> DataFrame:
    """Which tables of weights add up to 1, with the months that they apply to."""
    tables = {"scorecard": S.CARD, **X.REGIME_WEIGHTS}
    sizes = [(n, len(t), list(t.values())) for n, t in tables.items()]
    rows = spark.createDataFrame(sizes, "weights string, n int, w array<double>")
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    months = _months(spark, d).withColumn("weights", F.explode(F.array("regime", F.lit("scorecard")))).groupBy("weights").agg(F.sum("months").alias("months"))
    rows = rows.join(F.broadcast(months), "weights", "left")  # five rows
    return rows.select("weights", "n", (F.abs(total - 1) < 0.001).alias("complete"), F.coalesce("months", F.lit(0)).alias("months"))


#: A ranking's terms: the factor's column, its weight's name, and whether it is cleaned before.
_TERMS = {"vsm": "vsm", "bab": "bab", "upside": "upside", "pead": "pead", "sentiment": "sentiment", "revisions": "revisions", "capital_flow": "capital_flow", "advanced_rotation": "advanced_rotation"}


def _weight_of(name: str, regime: Column) -> Column:
    if name in S.ADDED:
        return F.lit(S.ADDED[name])
    out = F.when(regime == "Unknown", X.REGIME_WEIGHTS["Unknown"][name])
    for r, w in X.REGIME_WEIGHTS.items():
        out = out.when(regime == r, w[name])
    return out


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """ticker, sector, regime and the ranking's nine terms at the panel's last month end."""
    rows = panel(spark, d)
    last = rows.join(F.broadcast(rows.agg(F.max("as_of").alias("as_of"))), "as_of")
    mean = F.broadcast(last.agg(F.avg("mom").alias("mean")))
    regime = F.when(F.col("mean") > 0.02, "Bull").when(F.col("mean") < -0.02, "Bear").when(F.col("mean").isNull(), "Unknown").otherwise("Transition")
    parts = [
        valuation.f18_quality_minus_junk(spark, d).select("ticker", F.col("quality_z").alias("quality")),
        valuation.f27_valuation_composite(spark, d).select("ticker", F.col("composite").alias("upside")),
        R.latest(valuation.f22_earnings_drift(spark, d), ["ticker"], "period").select("ticker", "pead"),
        valuation.f25_news_sentiment(spark, d).select("ticker", "sentiment"),
        R.latest(valuation.f23_earnings_momentum(spark, d).select("ticker", "period", "revision"), ["ticker"], "period").select("ticker", F.col("revision").alias("revisions")),
        f36_capital_flow(spark, d).select("ticker", F.col("flow").alias("capital_flow")),
        f40_scorecard(spark, d).select("ticker", F.col("score").alias("advanced_rotation")),
    ]
    out = last.select("as_of", "ticker", "sector", "vsm", "bab").join(mean).withColumn("regime", regime).drop("mean")
    for p in parts:
        out = out.join(p, "ticker", "left")
    return out.na.fill(0.0, ["quality", *_TERMS])


_COLUMNS = ["vsm", "bab", "upside", "pead", "sentiment", "revisions", "capital_flow", "advanced_rotation"]


def _weight_sql(name: str) -> str:
    if name in S.ADDED:
        return str(S.ADDED[name])
    return "CASE regime " + " ".join(f"WHEN '{r}' THEN {w[name]}" for r, w in X.REGIME_WEIGHTS.items()) + " END"


_RANKING = f"""WITH q AS ({SQL['f18_quality_minus_junk']}), u AS ({SQL['f27_valuation_composite']}), pd AS (SELECT ticker, arg_max(pead, period) AS pead FROM ({SQL['f22_earnings_drift']}) GROUP BY 1), se AS ({SQL['f25_news_sentiment']}),
rv AS (SELECT ticker, max(struct_pack(p := period, r := revision)).r AS revisions FROM ({SQL['f23_earnings_momentum']}) GROUP BY 1), cf AS ({SQL['f36_capital_flow']}), ar AS ({SQL['f40_scorecard']}), lk AS ({SQL['f42_supply_chain_momentum']}), {_PANEL},
lp AS (SELECT * FROM panel WHERE as_of = (SELECT max(as_of) FROM panel)), rg AS (SELECT CASE WHEN avg(mom) > 0.02 THEN 'Bull' WHEN avg(mom) < -0.02 THEN 'Bear' WHEN avg(mom) IS NULL THEN 'Unknown' ELSE 'Transition' END AS regime FROM lp),
b AS (SELECT lp.ticker, lp.sector, regime, coalesce(vsm, 0) AS vsm, coalesce(bab, 0) AS bab, coalesce(quality_z, 0) AS quality, coalesce(composite, 0) AS upside, coalesce(pead, 0) AS pead, coalesce(sentiment, 0) AS sentiment,
coalesce(revisions, 0) AS revisions, coalesce(flow, 0) AS capital_flow, coalesce(ar.score, 0) AS advanced_rotation, lk.value AS linked FROM lp CROSS JOIN rg LEFT JOIN q USING (ticker) LEFT JOIN u USING (ticker) LEFT JOIN pd USING (ticker) LEFT JOIN se USING (ticker) LEFT JOIN rv USING (ticker)
LEFT JOIN cf ON cf.ticker = lp.ticker LEFT JOIN ar ON ar.ticker = lp.ticker LEFT JOIN lk ON lk.ticker = lp.ticker),
e AS (SELECT {', '.join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _COLUMNS)} FROM b),
wn AS (SELECT ticker, sector, regime, quality, linked, {', '.join(f"greatest(lo_{c}, least(hi_{c}, {c})) AS {c}" for c in _COLUMNS)} FROM b, e),
z AS (SELECT ticker, sector, regime, quality, (linked - avg(linked) OVER ()) / nullif(stddev_samp(linked) OVER (), 0) AS zl, {', '.join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0) AS {c}" for c in _COLUMNS)} FROM wn),
nz AS (SELECT ticker, regime, quality, zl, {', '.join(f"{c} - avg({c}) OVER (PARTITION BY sector) AS {c}" for c in _COLUMNS)} FROM z),
s AS (SELECT ticker, regime, {_weight_sql('qmj')} * quality + {' + '.join(f"({_weight_sql(c)}) * {c}" for c in _COLUMNS)} AS base, coalesce(zl, 0) AS learnt FROM nz),
fin AS (SELECT ticker, regime, round(base, 5)::DOUBLE AS base, round(0.6 * base + 0.4 * learnt, 5)::DOUBLE AS score FROM s)
SELECT ticker, regime, base, score, CAST(row_number() OVER (ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM fin"""


@query(_RANKING)
@V.bars_once
def x14_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Nine cleaned terms under the regime's weights, with a learnt score (what neighbours pass on) at 0.4, ranked without ties."""
    rows = X.cleaned(ranking(spark, d), ["as_of"], "sector", _COLUMNS)
    linked = factors.f42_supply_chain_momentum(spark, d).select("ticker", F.col("value").alias("linked"))
    rows = rows.join(linked, "ticker", "left").withColumn("learnt", F.coalesce(X.z_score("linked", "as_of"), F.lit(0.0)))
    base = _weight_of("qmj", F.col("regime")) * F.col("quality")
    for c in _COLUMNS:
        base = base + _weight_of(c, F.col("regime")) * F.col(f"z_{c}_neutral")
    rows = rows.select("as_of", "ticker", "regime", base.alias("raw"), "learnt")
    rows = rows.select("as_of", "ticker", "regime", F.round("raw", 5).alias("base"), F.round((1 - S.LEARNT) * F.col("raw") + S.LEARNT * F.col("learnt"), 5).alias("score"))
    return X.ranked(rows, ["as_of"], "score").select("ticker", "regime", "base", "score", "rank")


@query(f"SELECT ticker, sharpe, least(1.2, greatest(0.5, 0.5 + 0.5 * sharpe))::DOUBLE AS multiplier FROM ({SQL['b06_performance']})")
def p07_confidence(spark: SparkSession, d: str) -> DataFrame:
    """What each ticker's own Sharpe ratio would scale its position by."""
    return backtest.b06_performance(spark, d).select("ticker", "sharpe", S.confidence(F.col("sharpe")).alias("multiplier"))


@query(f"""WITH f AS ({SQL['f14_fundamental_scores']}), p AS ({SQL['b06_performance']}), r AS ({SQL['f27_valuation_composite']}) SELECT ticker, quality, value, growth, composite, yield_spread, vol, sharpe, max_drawdown FROM f LEFT JOIN p USING (ticker) LEFT JOIN r USING (ticker)""")
@V.bars_once
def h26_combined_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Scores, valuation and risk of a company in one row."""
    rows = valuation.f14_fundamental_scores(spark, d).join(backtest.b06_performance(spark, d), "ticker", "left").join(valuation.f27_valuation_composite(spark, d), "ticker", "left")
    return rows.select("ticker", "quality", "value", "growth", "composite", "yield_spread", "vol", "sharpe", "max_drawdown")


@query(f"""WITH s AS ({SQL['f36_capital_flow']}) SELECT ticker, least(1, greatest(-1, flow))::DOUBLE AS flow, CASE WHEN flow > 0.3 THEN 'inflow' WHEN flow < -0.3 THEN 'outflow' ELSE 'neutral' END AS class FROM s""")
def h35_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results as JSON and back, with bounds held on the way in."""
    flow = F.col("flow")
    kind = F.when(flow > 0.3, "inflow").when(flow < -0.3, "outflow").otherwise("neutral")
    sent = f36_capital_flow(spark, d).select(F.to_json(F.struct("ticker", "flow", kind.alias("class"))).alias("json"))
    back = sent.select(F.from_json("json", "ticker long, flow double, class string").alias("r"))
    return back.select("r.ticker", clip(F.col("r.flow"), -1.0, 1.0).alias("flow"), "r.class")


@query(f"""WITH {V.RETS}, s AS (SELECT ticker, avg(ret) AS m, stddev_samp(ret) AS sd, arg_max(ret, date) FILTER (ret IS NOT NULL) AS last_ FROM rets GROUP BY 1)
SELECT ticker, round(CASE WHEN sd > 0 THEN exp(-pow((last_ - m) / sd, 2) / 2) / (sd * sqrt(2 * pi())) ELSE 0 END, 5) AS density FROM s""")
def s17_return_density(spark: SparkSession, d: str) -> DataFrame:
    """The normal density of each ticker's last return; 0 where there is no spread to speak of."""
    rows = V.returns(spark, d).where("ret IS NOT NULL").groupBy("ticker").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.max_by("ret", "date").alias("last"))
    all_ = V.bars(spark, d).select("ticker").distinct().join(rows, "ticker", "left")
    return all_.select("ticker", F.round(finite(F.when(F.col("sd") > 0, norm_pdf(F.col("last"), F.col("m"), F.col("sd")))), 5).alias("density"))
