"""The risk gauge of sectors, attributions of stored targets, and experiments that are saved, listed and loaded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio, six
from tidemark.functions.windows import by_ticker, rolling
from tidemark.operators import gauge as G
from tidemark.operators import scoring as S
from tidemark.operators.backtest import index_level, selected
from tidemark.plans import valuation
from tidemark.plans.backtest import _SELECTED, scores
from tidemark.plans.registry import SQL, query
from tidemark.plans.xsec import panel
from tidemark.shared import checkpointed, shared_dir
from tidemark.sources import lake
from tidemark.sources import views as V


@V.bars_once
def _series(spark: SparkSession, d: str) -> DataFrame:
    """sector, name, date, value: seven daily series of each sector, from its bars.

    The level of the sector, the volatility of its mean return over 21 days, its level over the market's, the volume of falling
    against that of rising tickers, the share of rising ones; highs and lows are spread by tax and discount, which stand for rates.
    """
    rets = V.returns(spark, d)
    rows = rets.join(V.security(spark, d).select("ticker", "sector"), "ticker")
    day = rows.groupBy("sector", "date").agg(
        F.avg("ret").alias("ret"), F.avg((F.col("ret") > 0).cast("double") * 100).alias("fear_greed"),
        ratio(F.sum(F.when(F.col("ret") < 0, F.col("volume"))), F.sum(F.when(F.col("ret") > 0, F.col("volume")))).alias("put_call"),
        F.avg(100 * (F.col("high") / F.col("close") - 1)).alias("yield_10y"), F.avg(100 * (1 - F.col("low") / F.col("close"))).alias("rate_3m"),
    )
    w = Window.partitionBy("sector").orderBy("date")
    day = checkpointed(day.where("ret IS NOT NULL"))  # a row for each sector and day
    market = index_level(V.market(rets), "mkt")
    day = day.withColumn("deviation", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    day = day.withColumn("volatility", 100 * 252**0.5 * F.stddev_samp("ret").over(w.rowsBetween(-20, 0)))
    day = day.join(market, "date").withColumn("smart_money", ratio(F.col("deviation"), F.col("level")))
    return day.unpivot(["sector", "date"], list(G.LADDERS), "name", "value")


def _along_sql(x: str, points: tuple[tuple[float, float], ...]) -> str:
    return f"({points[0][1]}" + "".join(f" + least(1, greatest(0, ({x} - {a}) / {b - a})) * {high - low}" for (a, low), (b, high) in zip(points, points[1:], strict=False)) + ")"


def _case(what: str) -> str:
    return "CASE name " + " ".join(f"WHEN '{n}' THEN {getattr(x, what)}" for n, x in G.LADDERS.items()) + " END"


_GAUGE = f"""WITH {V.MARKET}, {V.SECURITY}, dy AS (SELECT sector, date, avg(ret) AS ret, avg(CASE WHEN ret > 0 THEN 100.0 WHEN ret <= 0 THEN 0.0 END) AS fear_greed, sum(CASE WHEN ret < 0 THEN volume END)::DOUBLE / nullif(sum(CASE WHEN ret > 0 THEN volume END), 0) AS put_call,
avg(100 * (high / close - 1)) AS yield_10y, avg(100 * (1 - low / close)) AS rate_3m FROM rets JOIN security USING (ticker) GROUP BY 1, 2),
lv AS (SELECT date, exp(sum(ln(1 + mkt)) OVER (ORDER BY date)) AS level FROM market), l AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY sector ORDER BY date)) AS deviation, 100 * sqrt(252) * stddev_samp(ret) OVER (PARTITION BY sector ORDER BY date ROWS 20 PRECEDING) AS volatility FROM dy WHERE ret IS NOT NULL),
s AS (SELECT sector, date, unnest([{', '.join(f"{{'n': '{n}', 'v': {'deviation / nullif(level, 0)' if n == 'smart_money' else n}::DOUBLE}}" for n in G.LADDERS)}]) AS x FROM l JOIN lv USING (date)),
e AS (SELECT sector, x.n AS name, date, x.v AS value, max(date) OVER (PARTITION BY sector, x.n) AS end_ FROM s WHERE x.v IS NOT NULL), k AS (SELECT *, row_number() OVER w AS k, avg(value) OVER (w ROWS 199 PRECEDING) AS mean FROM e WHERE date > end_ - INTERVAL 120 MONTH WINDOW w AS (PARTITION BY sector, name ORDER BY date)),
a AS (SELECT *, CASE WHEN k >= 200 THEN (value - mean) / nullif(mean, 0) END AS away FROM k), nw AS (SELECT *, max(CASE WHEN date = end_ THEN away END) OVER (PARTITION BY sector, name) AS now_ FROM a),
g AS (SELECT sector, name, arg_max(value, date) AS last_, max(now_) AS now_, 100 * avg(CASE WHEN away < now_ THEN 1.0 ELSE 0.0 END) AS below, count(*) AS n FROM nw GROUP BY 1, 2),
h AS (SELECT sector, name, CASE WHEN name = 'deviation' THEN 100 * now_ ELSE last_ END AS value, CASE name {' '.join(f"WHEN '{n}' THEN {_along_sql({'deviation': 'below', 'smart_money': 'now_'}.get(n, 'last_'), x.points)}" for n, x in G.LADDERS.items())} END AS score, {_case('weight')} AS weight FROM g WHERE name <> 'smart_money' OR n > 200)"""


@query(f"{_GAUGE} SELECT sector, name, round(value, 6) AS value, round(score, 4) AS score, CASE WHEN score >= {_case('high')} THEN 'High Risk' WHEN score >= {_case('middle')} THEN 'Neutral' ELSE 'Low Risk' END AS signal FROM h")
def x23_indicators(spark: SparkSession, d: str) -> DataFrame:
    """The seven indicators of each sector's last day."""
    return G.indicators(_series(spark, d), ["sector"]).select("sector", "name", six(F.col("value")).alias("value"), F.round("score", 4).alias("score"), "signal")


@query(f"""{_GAUGE}, c AS (SELECT sector, count(*) AS n, sum(score * weight) / sum(weight) AS total FROM h WHERE score IS NOT NULL GROUP BY 1)
SELECT sector, n, round(total, 1)::DOUBLE AS score, CASE {' '.join(f"WHEN total > {b} THEN '{r}'" for b, r in G.RATINGS)} ELSE '{G.LOWEST}' END AS rating FROM c""")
def x23_risk_gauge(spark: SparkSession, d: str) -> DataFrame:
    """The indicators' weighted mean and its rating."""
    return G.composite(G.indicators(_series(spark, d), ["sector"]), ["sector"])


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {_SELECTED}, fs AS ({SQL['f14_fundamental_scores']}), ex AS (SELECT h.as_of, h.ticker, weight, sc.score, vsm, bab, fs.quality, fs.value FROM held h JOIN sc ON sc.ticker = h.ticker AND sc.as_of = h.as_of JOIN panel p ON p.ticker = h.ticker AND p.as_of = h.as_of LEFT JOIN fs ON fs.ticker = h.ticker)
SELECT as_of, round(sum(weight * coalesce(value, 0)) / sum(weight), 2)::DOUBLE AS value, round(sum(weight * coalesce(vsm, 0)) / sum(weight), 2) AS momentum, round(sum(weight * coalesce(quality, 0)) / sum(weight), 2)::DOUBLE AS quality, round(sum(weight * coalesce(bab, 0)) / sum(weight), 2) AS low_risk, 0.0::DOUBLE AS sentiment,
count(*) FILTER (score >= 2) AS high, count(*) FILTER (score >= 1 AND score < 2) AS medium, count(*) FILTER (score < 1) AS low FROM ex GROUP BY 1""")
@V.bars_once
def x22_attribution(spark: SparkSession, d: str) -> DataFrame:
    """What five groups of factors add to each date's stored targets, by their weights and the metadata of the stored signals; and how many names are held with which conviction."""
    rows = checkpointed(scores(spark, d))
    known = valuation.f14_fundamental_scores(spark, d).select("ticker", F.col("quality").alias("roe"), F.col("value").alias("valuation_composite"))
    signals = rows.drop("sector").join(panel(spark, d).select("as_of", "ticker", "vsm", "bab"), ["as_of", "ticker"]).join(known, "ticker", "left")
    rank = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "ticker"))
    signals = signals.select("ticker", F.col("as_of").alias("date"), F.lit("ranking_v3").alias("model_name"), "score", rank.alias("rank"), "vsm", "bab", "roe", "valuation_composite")
    at = _path(spark, "attribution")
    lake.write_signals(signals, f"{at}/signals")
    held = selected(rows, "as_of", "score").select("ticker", F.col("as_of").alias("date"), F.lit("kelly_v1").alias("model_name"), "weight")
    lake.write_targets(held, f"{at}/targets")
    out = S.attributed(spark.read.parquet(f"{at}/targets"), spark.read.parquet(f"{at}/signals"))
    return out.select(F.col("date").cast("date").alias("as_of"), *[F.round(g, 2).alias(g) for g in S.GROUPS], "high", "medium", "low")


_LOOKBACKS = (20, 60, 120)


@query(f"""WITH {V.RETS}, s AS (SELECT date, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS nxt, close, {', '.join(f"CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) >= {n} THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING) END AS s{n}" for n in _LOOKBACKS)} FROM rets),
u AS (SELECT last_day(date) AS date, unnest([{', '.join(f"{{'n': {n}, 's': s{n}}}" for n in _LOOKBACKS)}]) AS x, nxt, close FROM s), m AS (SELECT x.n AS lookback, date, avg(nxt) AS ret FROM u WHERE close > 1.001 * x.s AND nxt IS NOT NULL GROUP BY 1, 2),
r AS (SELECT lookback, '2024-01-02_' || substr(md5('{{"lookback":' || lookback || ',"rule":"above_mean"}}'), 1, 6) AS id, count(*) AS months, exp(sum(ln(1 + ret))) - 1 AS total FROM m GROUP BY 1),
b AS (SELECT id AS run_id, 'first' AS note, lookback, months, total FROM r UNION ALL SELECT id || '_1', 'again', lookback, months, total FROM r)
SELECT run_id, note, CAST(lookback AS INTEGER) AS lookback, months, round(total, 6) AS total FROM b ORDER BY run_id DESC LIMIT 4""")
def sc15_experiments(spark: SparkSession, d: str) -> DataFrame:
    """SK06 and SC15: a sweep's runs saved twice on one day, so that the second ones get a suffix; the four newest listed with what their stored curves add up to."""
    cases = F.array(*[F.struct(F.lit(n).alias("lookback"), rolling(F.avg, F.col("close"), n).alias("mean")) for n in _LOOKBACKS])
    rows = V.returns(spark, d).select("date", "close", F.lead("ret").over(by_ticker()).alias("nxt"), cases.alias("cases"))
    rows = rows.select(F.last_day("date").alias("date"), "close", "nxt", F.explode("cases").alias("c")).where("close > 1.001 * c.mean AND nxt IS NOT NULL")
    curves = checkpointed(rows.groupBy(F.col("c.lookback").alias("run"), "date").agg(F.avg("nxt").alias("ret")))
    configs = curves.select("run").distinct().select("run", F.to_json(F.struct(F.col("run").alias("lookback"), F.lit("above_mean").alias("rule"))).alias("config"))
    totals = curves.groupBy("run").agg(F.count("*").alias("months"), (F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("total"))
    at = _path(spark, "experiments")
    for note in ("first", "again"):
        runs = configs.join(totals.select("run", F.to_json(F.struct("months", "total")).alias("metrics")), "run")
        lake.save_experiments(runs.withColumn("metadata", F.lit(f'{{"note":"{note}"}}')), at, "2024-01-02", equity_curve=curves)
    listed = lake.experiments(spark, at, 4)
    held = lake.experiment_rows(spark, at, "equity_curve").groupBy("run_id").agg(F.count("*").alias("months"), (F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("total"))
    out = listed.join(held, "run_id", "left")
    return out.select("run_id", F.get_json_object("metadata", "$.note").alias("note"), F.get_json_object("config", "$.lookback").cast("int").alias("lookback"), "months", six(F.col("total")).alias("total"))
