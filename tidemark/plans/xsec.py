"""Cross-sectional cleaning, ranking, blending and the flagship point-in-time score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio, six
from tidemark.functions.windows import month_ends, rank_share, rolled, whole
from tidemark.operators import factors as A
from tidemark.operators import relational as R
from tidemark.operators import xsec as X
from tidemark.plans.registry import query, sixes
from tidemark.sources import views as V

_W = "PARTITION BY ticker ORDER BY date"
_M = f"({_W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
#: A month's last bar of each ticker with three factors known by then.
_PANEL = f"""{V.MARKET}, {V.SECURITY}, j AS (SELECT r.*, mkt FROM rets r JOIN market USING (date) WHERE ret IS NOT NULL),
w AS (SELECT ticker, date, count(ret) OVER {_M} AS n, (exp(sum(ln(1 + ret)) OVER {_M}) - 1) / nullif(stddev_samp(ret) OVER {_M} * sqrt(252), 0) AS vsm,
-covar_samp(ret, mkt) OVER {_M} / nullif(var_samp(mkt) OVER {_M}, 0) AS bab, close / nullif(lag(close, 251) OVER ({_W}), 0) - close / nullif(lag(close, 20) OVER ({_W}), 0) AS mom FROM j),
f AS (SELECT last_day(date) AS as_of, ticker, arg_max(vsm, date) AS vsm, arg_max(bab, date) AS bab, arg_max(mom, date) AS mom FROM w WHERE n >= 252 AND mom IS NOT NULL GROUP BY 1, 2),
panel AS (SELECT as_of, ticker, sector, round(vsm, 8) AS vsm, round(bab, 8) AS bab, round(mom, 8) AS mom FROM f JOIN security USING (ticker))"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    """as_of (month end), ticker, sector, vsm, bab, mom: every rebalance date at once, in one pass over the bars."""
    rets = V.returns(spark, d).where("ret IS NOT NULL")
    rows = rets.join(F.broadcast(V.market(rets)), "date").withColumn("mom", A.momentum_difference())  # a row a day
    ret, mkt = F.col("ret"), F.col("mkt")
    rows = rolled(rows, 252, n=F.lit(1.0), r=ret, rr=ret * ret, m=mkt, mm=mkt * mkt, rm=ret * mkt, logs=F.ln(1 + ret))
    cov, var, own = (F.col(c) - F.col(a) * F.col(b) / F.col("n") for c, a, b in (("rm", "r", "m"), ("mm", "m", "m"), ("rr", "r", "r")))
    vsm = ratio(F.exp("logs") - 1, F.sqrt(F.greatest(own, F.lit(0.0)) / (F.col("n") - 1) * 252))
    last = month_ends(rows.where("n >= 252 AND mom IS NOT NULL"))
    last = last.select("as_of", "ticker", *[F.round(x, 8).alias(c) for c, x in (("vsm", vsm), ("bab", -ratio(cov, var)), ("mom", F.col("mom")))])
    return last.join(V.security(spark, d).select("ticker", "sector"), "ticker").select("as_of", "ticker", "sector", "vsm", "bab", "mom")


def _z(c: str) -> str:
    return f"coalesce(({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0), 0)"


_WINS = "q AS (SELECT as_of, " + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in ("vsm", "bab", "mom")) + " FROM panel GROUP BY 1), wn AS (SELECT as_of, ticker, sector, " + ", ".join(f"greatest(lo_{c}, least(hi_{c}, {c})) AS {c}" for c in ("vsm", "bab", "mom")) + " FROM panel JOIN q USING (as_of))"
_CLEAN = f"""{_WINS}, z AS (SELECT as_of, ticker, sector, {_z('vsm')} AS z_vsm, {_z('bab')} AS z_bab, {_z('mom')} AS z_mom FROM wn WINDOW d AS (PARTITION BY as_of))"""


@query(f"""WITH {_PANEL}, {_CLEAN}, s AS (SELECT *, round((z_vsm + z_bab + z_mom) / 3, 6) AS score FROM z)
SELECT as_of, ticker, score, CAST(row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM s""")
def x_pit_score(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: F04, F07 and F08 at each month's end, winsorised, standardised, averaged and ranked."""
    z = X.winsorised(panel(spark, d), ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", *[X.z_score(c, "as_of").alias(c) for c in ("vsm", "bab", "mom")])
    return X.ranked(z.select("as_of", "ticker", six((F.col("vsm") + F.col("bab") + F.col("mom")) / 3).alias("score")), ["as_of"], "score")


@query(f"WITH {_PANEL}, {_WINS} SELECT as_of, ticker, vsm, bab, mom FROM wn")
def x01_winsorised(spark: SparkSession, d: str) -> DataFrame:
    return X.winsorised(panel(spark, d), ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", "vsm", "bab", "mom")


@query(f"""WITH {_PANEL}, {_CLEAN} SELECT as_of, ticker, {sixes('z_vsm', 'z_bab', 'z_mom')}, round(z_vsm - avg(z_vsm) OVER n, 6) AS z_vsm_neutral, round(z_bab - avg(z_bab) OVER n, 6) AS z_bab_neutral,
round(z_mom - avg(z_mom) OVER n, 6) AS z_mom_neutral FROM z WINDOW n AS (PARTITION BY as_of, sector)""")
def x06_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """X02, X05 and X06."""
    columns = [f"z_{c}{n}" for c in ("vsm", "bab", "mom") for n in ("", "_neutral")]
    return X.cleaned(panel(spark, d), ["as_of"], "sector", ["vsm", "bab", "mom"]).select("as_of", "ticker", *[six(F.col(c)).alias(c) for c in columns])


@query(f"""WITH {_PANEL}, q AS (SELECT as_of, quantile_cont(mom, 0.25) AS a, median(mom) AS m, quantile_cont(mom, 0.75) AS b FROM panel GROUP BY 1)
SELECT as_of, ticker, round(CASE WHEN b - a < 1e-10 THEN 0 ELSE (mom - m) / ((b - a) / 1.35) END, 6) AS robust FROM panel JOIN q USING (as_of)""")
def x03_robust_z(spark: SparkSession, d: str) -> DataFrame:
    return X.robust_z(panel(spark, d), ["as_of"], "mom", "robust").select("as_of", "ticker", six(F.col("robust")).alias("robust"))


@query(f"""WITH {_PANEL} SELECT as_of, ticker, round((rank() OVER (PARTITION BY as_of ORDER BY mom) + (count(*) OVER (PARTITION BY as_of, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY as_of), 6) AS pct FROM panel""")
def x04_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("as_of", "ticker", six(rank_share(F.col("mom"), "as_of")).alias("pct"))


_REGIMES = "reg AS (SELECT as_of, CASE WHEN avg(mom) > 0.02 THEN 'Bull' WHEN avg(mom) < -0.02 THEN 'Bear' WHEN avg(mom) IS NULL THEN 'Unknown' ELSE 'Transition' END AS regime FROM panel GROUP BY 1), wt AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {w['vsm']}, {w['bab']})" for r, w in X.REGIME_WEIGHTS.items()) + ") t(regime, wv, wb))"


@query(f"""WITH {_PANEL}, {_CLEAN}, {_REGIMES}, h AS (SELECT z.as_of, ticker, regime, CASE WHEN ticker % 7 = 3 THEN NULL ELSE z_vsm END AS v, z_bab AS b FROM z JOIN reg USING (as_of))
SELECT as_of, ticker, h.regime, round(coalesce((coalesce(v, 0) * wv + b * wb) / nullif(CASE WHEN v IS NULL THEN 0 ELSE wv END + wb, 0), 0), 6) AS score FROM h JOIN wt ON h.regime = wt.regime""")
def x13_regime_composite(spark: SparkSession, d: str) -> DataFrame:
    """Weights by regime; those of factors that the panel doesn't have, or that are missing, are shared out."""
    rows = panel(spark, d)
    mean = rows.groupBy("as_of").agg(F.avg("mom").alias("mean"))
    regime = F.when(F.col("mean") > 0.02, "Bull").when(F.col("mean") < -0.02, "Bear").when(F.col("mean").isNull(), "Unknown").otherwise("Transition")
    z = X.winsorised(rows, ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", *[X.z_score(c, "as_of").alias(c) for c in ("vsm", "bab")])
    z = z.join(mean.select("as_of", regime.alias("regime")), "as_of").select("as_of", "ticker", "regime", F.when(F.col("ticker") % 7 != 3, F.col("vsm")).alias("vsm"), "bab")
    score = F.lit(None).cast("double")
    for name, weights in X.REGIME_WEIGHTS.items():
        score = F.when(F.col("regime") == name, X.weighted({c: weights[c] for c in ("vsm", "bab")})).otherwise(score)
    return z.select("as_of", "ticker", "regime", six(score).alias("score"))


@query(f"""WITH {_PANEL}, {_CLEAN}, {V.EDGES}, ml AS (SELECT supplier AS ticker, sum(weight) AS ml FROM edges WHERE supplier % 4 <> 0 GROUP BY 1),
b AS (SELECT as_of, ticker, (z_vsm + z_bab + z_mom) / 3 AS base, ml FROM z LEFT JOIN ml USING (ticker)),
n AS (SELECT *, count(ml) OVER (PARTITION BY as_of) / count(*) OVER (PARTITION BY as_of) AS coverage, coalesce((ml - avg(ml) OVER (PARTITION BY as_of)) / nullif(stddev_samp(ml) OVER (PARTITION BY as_of), 0), 0) AS zml FROM b),
s AS (SELECT as_of, ticker, round(CASE WHEN coverage > 0.1 THEN 0.4 * zml + 0.6 * base ELSE base END, 6) AS blended FROM n)
SELECT as_of, ticker, blended, CAST(row_number() OVER (PARTITION BY as_of ORDER BY blended DESC, ticker) AS INTEGER) AS rank FROM s""")
def x15_blend(spark: SparkSession, d: str) -> DataFrame:
    """A learnt score with missing tickers, blended 40/60 where it covers over a tenth of the universe."""
    z = X.winsorised(panel(spark, d), ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", *[X.z_score(c, "as_of").alias(c) for c in ("vsm", "bab", "mom")])
    learnt = V.edges(spark, d).where("supplier % 4 <> 0").groupBy(F.col("supplier").alias("ticker")).agg(F.sum("weight").alias("ml"))
    rows = z.select("as_of", "ticker", ((F.col("vsm") + F.col("bab") + F.col("mom")) / 3).alias("base")).join(learnt, "ticker", "left")
    covered = F.count("ml").over(whole("as_of")) / F.count("*").over(whole("as_of"))
    blended = F.when(covered > 0.1, 0.4 * F.coalesce(X.z_score("ml", "as_of"), F.lit(0.0)) + 0.6 * F.col("base")).otherwise(F.col("base"))
    return X.ranked(rows.select("as_of", "ticker", six(blended).alias("blended")), ["as_of"], "blended").select("as_of", "ticker", "blended", "rank")


@query(f"""WITH {_PANEL}, {_CLEAN}, s AS (SELECT as_of, ticker, (rank() OVER (PARTITION BY as_of ORDER BY z_mom) - 1.0) / nullif(count(*) OVER (PARTITION BY as_of) - 1, 0) AS c FROM z)
SELECT as_of, CASE WHEN c >= 0.8 THEN 'very high' WHEN c >= 0.6 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS conviction, count(*) AS n FROM s GROUP BY 1, 2""")
def x22_conviction_buckets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    z = X.winsorised(panel(spark, d), ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", X.z_score("mom", "as_of").alias("mom"))
    place = F.try_divide(F.rank().over(Window.partitionBy("as_of").orderBy("mom")) - 1.0, F.count("*").over(whole("as_of")) - 1)
    return z.select("as_of", X.bucketed(place).alias("conviction")).groupBy("as_of", "conviction").agg(F.count("*").alias("n"))


@query(f"""WITH {_PANEL}, {_CLEAN}, l AS (SELECT * FROM (SELECT as_of, ticker, 'vsm' AS factor, z_vsm AS c FROM z UNION ALL SELECT as_of, ticker, 'bab', z_bab FROM z UNION ALL SELECT as_of, ticker, 'mom', z_mom FROM z))
SELECT as_of, factor, round(sum(abs(c)) / nullif(sum(sum(abs(c))) OVER (PARTITION BY as_of), 0), 6) AS share FROM l GROUP BY 1, 2""")
def ag20_factor_concentration(spark: SparkSession, d: str) -> DataFrame:
    """AG20 and L05's concentration."""
    z = X.winsorised(panel(spark, d), ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", *[X.z_score(c, "as_of").alias(c) for c in ("vsm", "bab", "mom")])
    sums = R.narrow(z, ["as_of", "ticker"], ["vsm", "bab", "mom"]).groupBy("as_of", F.col("metric").alias("factor")).agg(F.sum(F.abs("value")).alias("s"))
    return sums.select("as_of", "factor", six(ratio(F.col("s"), F.sum("s").over(whole("as_of")))).alias("share"))


@query(f"""WITH {_PANEL}, {_CLEAN}, l AS (SELECT as_of, ticker, unnest([{{'f': 'vsm', 'c': z_vsm}}, {{'f': 'bab', 'c': z_bab}}, {{'f': 'mom', 'c': z_mom}}]) AS x FROM z),
k AS (SELECT as_of, ticker, x.f AS factor, x.c AS c, row_number() OVER (PARTITION BY as_of, ticker ORDER BY abs(x.c) DESC, x.f) AS k FROM l) SELECT as_of, ticker, factor, round(c, 6) AS contribution FROM k WHERE k = 1""")
def t05_top_contribution(spark: SparkSession, d: str) -> DataFrame:
    z = X.winsorised(panel(spark, d), ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", *[X.z_score(c, "as_of").alias(c) for c in ("vsm", "bab", "mom")])
    parts = F.array(*[F.struct((-F.abs(c)).alias("size"), F.lit(c).alias("factor"), F.col(c).alias("c")) for c in ("vsm", "bab", "mom")])
    return z.select("as_of", "ticker", F.array_min(parts).alias("x")).select("as_of", "ticker", "x.factor", six(F.col("x.c")).alias("contribution"))


@query(f"""WITH {_PANEL} SELECT round(corr(vsm, bab), 6) AS vsm_bab, round(corr(vsm, mom), 6) AS vsm_mom, round(corr(bab, mom), 6) AS bab_mom, count(*) AS n FROM panel""")
def x_factor_correlations(spark: SparkSession, d: str) -> DataFrame:
    """The factors' correlation matrix, computed rather than assumed."""
    return panel(spark, d).agg(six(F.corr("vsm", "bab")).alias("vsm_bab"), six(F.corr("vsm", "mom")).alias("vsm_mom"), six(F.corr("bab", "mom")).alias("bab_mom"), F.count("*").alias("n"))
