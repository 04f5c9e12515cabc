"""Regimes, regressions, attributions, forecasts and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio, six
from tidemark.functions.windows import RUNNING, by_ticker, rolling
from tidemark.operators import evolution as E
from tidemark.operators import factors as A
from tidemark.operators import learning as L
from tidemark.operators import regimes as H
from tidemark.operators import relational as R
from tidemark.operators import xsec as X
from tidemark.operators.backtest import index_level
from tidemark.operators.state import online_regime
from tidemark.plans.registry import query
from tidemark.plans.xsec import _PANEL, panel
from tidemark.sources import views as V

_W = "PARTITION BY ticker ORDER BY date"


def _n(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"""WITH RECURSIVE {V.RETS}, n AS (SELECT ticker, ret AS v, row_number() OVER ({_W}) AS k FROM rets WHERE ret IS NOT NULL),
s AS (SELECT DISTINCT ticker, 0::BIGINT AS k, 0.001::DOUBLE AS m1, 0.0004::DOUBLE AS v1, -0.001::DOUBLE AS m2, 0.0009::DOUBLE AS v2, 0.5::DOUBLE AS p FROM n
UNION ALL SELECT ticker, k, a1, greatest((1-r1)*v1 + r1*(v-a1)*(v-a1), 1e-8), a2, greatest((1-r2)*v2 + r2*(v-a2)*(v-a2), 1e-8), q FROM (SELECT *, m1 + r1*(v-m1) AS a1, m2 + r2*(v-m2) AS a2 FROM (
SELECT *, 0.03*q AS r1, 0.03*(1-q) AS r2 FROM (SELECT *, least(0.999, greatest(0.001, 0.9*coalesce(d1/nullif(d1+d2,0), p) + 0.05)) AS q FROM (
SELECT s.ticker, n.k, n.v, m1, v1, m2, v2, p, p*exp(-(n.v-m1)*(n.v-m1)/(2*v1))/sqrt(2*pi()*v1) AS d1, (1-p)*exp(-(n.v-m2)*(n.v-m2)/(2*v2))/sqrt(2*pi()*v2) AS d2 FROM s JOIN n ON n.ticker = s.ticker AND n.k = s.k + 1)))))
SELECT ticker, round(p, 6) AS bull, round(m1, 6) AS mean_bull, round(m2, 6) AS mean_bear, round(0.5 + 0.5 * p, 6) AS multiplier FROM s QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC) = 1""")
def x19_online_regime(spark: SparkSession, d: str) -> DataFrame:
    """X19 and H19."""
    out = online_regime(V.returns(spark, d).where("ret IS NOT NULL"), "ret")
    return out.select("ticker", *[six(F.col(c)).alias(c) for c in ("bull", "mean_bull", "mean_bear")], six(0.5 + 0.5 * F.col("bull")).alias("multiplier"))


@query(f"""WITH {V.RETS}, l AS (SELECT ticker, ret AS v, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM rets WHERE ret IS NOT NULL), w AS (SELECT *, min(v) OVER (PARTITION BY ticker) AS lo, max(v) OVER (PARTITION BY ticker) AS hi FROM l WHERE k <= 20),
b AS (SELECT ticker, k <= 10 AS newer, least(9, floor(coalesce((v - lo) * 10 / nullif(hi - lo, 0), 0))) AS bin FROM w), s AS (SELECT ticker, bin, (count(*) FILTER (newer) + 0.01) / 10.1 AS p, (count(*) FILTER (NOT newer) + 0.01) / 10.1 AS q FROM b GROUP BY 1, 2)
SELECT ticker, round(sum(p * ln(p / q)), 6) AS kl, sum(p * ln(p / q)) > 0.1 AS drifted FROM s GROUP BY 1""")
def x20_drift(spark: SparkSession, d: str) -> DataFrame:
    return L.drift(V.returns(spark, d).where("ret IS NOT NULL"), "ret").withColumn("kl", six(F.col("kl")))


@query(None)
def x18_hidden_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Two Gaussian regimes of a ticker's returns: the last day's state on the most probable path."""
    out = H.regime_paths(V.returns(spark, d), "ret")
    return R.latest(out, ["ticker"], "date").select("ticker", "regime", *[six(F.col(c)).alias(c) for c in ("bull", "mean_bull", "mean_bear", "multiplier")])


@query(None)
def x18_regime_path(spark: SparkSession, d: str) -> DataFrame:
    """The decoded regime and the probability of the better one, for each of a ticker's last 252 returns."""
    return H.regime_paths(V.returns(spark, d), "ret").select("ticker", "date", "regime", six(F.col("bull")).alias("bull"))


_OLS = f"""{_PANEL}, mo AS (SELECT as_of, count(*) AS n, avg(mom) AS my, avg(vsm) AS ma, avg(bab) AS mb, var_pop(vsm) AS va, var_pop(bab) AS vb, var_pop(mom) AS vy, covar_pop(vsm, bab) AS ab, covar_pop(vsm, mom) AS ay, covar_pop(bab, mom) AS by_ FROM panel GROUP BY 1),
ols AS (SELECT *, (vb*ay - ab*by_) / nullif(va*vb - ab*ab, 0) AS ca, (va*by_ - ab*ay) / nullif(va*vb - ab*ab, 0) AS cb FROM mo WHERE n >= 8)"""


@query(f"""WITH {_OLS} SELECT p.as_of, ticker, round(mom - (my - ca*ma - cb*mb) - ca*vsm - cb*bab, 5) AS residual, round((ca*ay + cb*by_) / nullif(vy, 0), 5) AS r2 FROM panel p JOIN ols USING (as_of)""")
def l04_residual_alpha(spark: SparkSession, d: str) -> DataFrame:
    """What two factors leave of a third, orthogonal to both."""
    rows = panel(spark, d)
    fit = L.two_factor_ols(rows, ["as_of"], "mom", "vsm", "bab").where("n >= 8")
    c = F.col
    return rows.join(fit, "as_of").select("as_of", "ticker", F.round(c("mom") - c("c0") - c("ca") * c("vsm") - c("cb") * c("bab"), 5).alias("residual"), F.round("r2", 5).alias("r2"))


@query(f"""WITH {_OLS} SELECT p.as_of, ticker, round(ca * (vsm - ma), 5) AS by_vsm, round(cb * (bab - mb), 5) AS by_bab FROM panel p JOIN ols USING (as_of)""")
def l05_linear_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The share of each factor in a linear prediction: coefficient times distance from the mean."""
    rows = panel(spark, d)
    fit = L.two_factor_ols(rows, ["as_of"], "mom", "vsm", "bab").where("n >= 8")
    return rows.join(fit, "as_of").select("as_of", "ticker", F.round(F.col("ca") * (F.col("vsm") - F.col("ma")), 5).alias("by_vsm"), F.round(F.col("cb") * (F.col("bab") - F.col("mb")), 5).alias("by_bab"))


@query(None)
def l06_shape_functions(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.shared import checkpointed

    out, _ = L.shape_functions(checkpointed(panel(spark, d)), "mom", ["vsm", "bab"])
    return out.select("as_of", "ticker", *[six(F.col(c)).alias(c) for c in ("f_vsm", "f_bab", "prediction")])


@query(None)
@V.bars_once
def l02_meta_labels(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on triple-barrier labels, fitted on the first seven tenths of days and scored on the rest; 40 days between are purged, so no label of one overlaps the other."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidemark.shared import checkpointed

    rets = V.returns(spark, d)
    known = ("m6", "v60", "illiquid", "levy")
    rows = rets.select("*", A.momentum_6m(RUNNING).alias("m6"), A.volatility_60d(RUNNING).alias("v60"), A.amihud(RUNNING).alias("illiquid"), A.levy(at=RUNNING).alias("levy"))
    # labels beside the factors of the same row: no join of all days with themselves
    rows = A.triple_barrier(rows, keep=known).select("ticker", "date", *known, (F.col("label") > 0).cast("double").alias("label")).na.drop()
    rows = checkpointed(VectorAssembler(inputCols=["m6", "v60", "illiquid", "levy"], outputCol="features").transform(rows).select("ticker", "date", "label", "features"))
    first = rows.agg(F.date_from_unix_date(F.percentile_approx(F.unix_date("date"), 0.7)).alias("d")).first()["d"]
    day = F.lit(first).cast("date")
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=42).fit(rows.where(F.col("date") < F.date_sub(day, 40)))
    return model.transform(rows.where(F.col("date") >= day)).select("ticker", "date", "label", six(vector_to_array("probability")[1]).alias("p"))


@query(f"""WITH {V.RETS}, m AS (SELECT ticker, avg(ret) AS mu, stddev_samp(ret) AS sd, count(ret) AS n FROM rets GROUP BY 1), h AS (SELECT *, unnest([1, 5, 21]) AS h FROM m WHERE n >= 60)
SELECT ticker, CAST(h AS INTEGER) AS h, round(mu * h, 6) AS mid, round(mu * h - 2 * sd * sqrt(h), 6) AS low, round(mu * h + 2 * sd * sqrt(h), 6) AS high FROM h""")
def l09_forecast_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = V.returns(spark, d).groupBy("ticker").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n")).where("n >= 60")
    rows = rows.withColumn("h", F.explode(F.array(F.lit(1), F.lit(5), F.lit(21))))
    mid, wide = F.col("mu") * F.col("h"), 2 * F.col("sd") * F.sqrt("h")
    return rows.select("ticker", "h", six(mid).alias("mid"), six(mid - wide).alias("low"), six(mid + wide).alias("high"))


@query("""WITH r AS (SELECT o_orderpriority AS experiment, o_custkey AS run, avg(o_totalprice) AS metric FROM orders GROUP BY 1, 2) SELECT experiment, run, round(metric, 4) AS metric FROM r QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY metric DESC, run) = 1""")
def l10_best_run(spark: SparkSession, d: str) -> DataFrame:
    runs = V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("experiment"), F.col("o_custkey").alias("run")).agg(F.avg("o_totalprice").alias("metric"))
    return R.top_k(runs, ["experiment"], [F.desc("metric"), F.asc("run")], 1).select("experiment", "run", F.round("metric", 4).alias("metric"))


@query(f"""WITH {V.BARS}, {V.EDGES}, c AS (SELECT ticker, date, close / nullif(lag(close, 1) OVER ({_W}), 0) - 1 AS r1, close / nullif(lag(close, 5) OVER ({_W}), 0) - 1 AS r5, close / nullif(lag(close, 21) OVER ({_W}), 0) - 1 AS r21 FROM bars),
x AS (SELECT ticker, r1, r5, r21 FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1), sides AS (SELECT supplier AS ticker, customer AS other, weight FROM edges UNION ALL SELECT customer, supplier, weight FROM edges),
s AS (SELECT b.ticker, sum(abs(r1)*weight)+1e-3 AS a1, sum(abs(r5)*weight)+1e-3 AS a5, sum(abs(r21)*weight)+1e-3 AS a21, sum(weight*r1)/sum(weight) AS m1, sum(weight*r5)/sum(weight) AS m5, sum(weight*r21)/sum(weight) AS m21 FROM sides b JOIN x ON b.other = x.ticker GROUP BY 1)
SELECT ticker, round((a1*m1 + a5*m5 + a21*m21) / (a1 + a5 + a21), 6) AS signal, round(greatest(a1, a5, a21) / (a1 + a5 + a21), 6) AS attention FROM s""")
def f43_temporal_attention(spark: SparkSession, d: str) -> DataFrame:
    """neighbours' moves over 1, 5 and 21 rows, weighted by how much of the neighbours' movement each shows."""
    from tidemark.functions.windows import change

    spans = (1, 5, 21)
    moves = V.bars(spark, d).select("ticker", "date", *[change(F.col("close"), n).alias(f"r{n}") for n in spans])
    last = R.latest(moves, ["ticker"], "date").select(F.col("ticker").alias("other"), *[f"r{n}" for n in spans])
    both = R.both_ways(V.edges(spark, d)).join(last, "other")
    w = F.col("weight")
    sums = both.groupBy("ticker").agg(*[(F.sum(F.abs(f"r{n}") * w) + 1e-3).alias(f"a{n}") for n in spans], *[(F.sum(w * F.col(f"r{n}")) / F.sum(w)).alias(f"m{n}") for n in spans])
    total = sum((F.col(f"a{n}") for n in spans), F.lit(0.0))
    return sums.select("ticker", six(sum((F.col(f"a{n}") * F.col(f"m{n}") for n in spans), F.lit(0.0)) / total).alias("signal"), six(F.greatest(*[F.col(f"a{n}") for n in spans]) / total).alias("attention"))


@query(f"""WITH {V.RETS}, s AS (SELECT ticker, date, CASE WHEN close / nullif(CASE WHEN count(close) OVER {_n(130)} >= 130 THEN avg(close) OVER {_n(130)} END, 0) > 1.005 THEN 'buy' ELSE 'hold' END AS rating,
{', '.join(f"lead(close, {n}) OVER ({_W}) / close - 1 AS f{n}" for n in (21, 63, 126, 252))} FROM rets)
SELECT rating, count(*) AS n, {', '.join(f"round(avg(f{n}), 6) AS f{n}, round(avg(CASE WHEN f{n} > 0 THEN 1.0 WHEN f{n} <= 0 THEN 0.0 END), 6) AS hit{n}" for n in (21, 63, 126, 252))} FROM s GROUP BY 1""")
def b22_forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """B22 and AG21: what followed each rating over one, three, six and twelve months."""
    spans = (21, 63, 126, 252)
    rating = F.when(A.levy() > 1.005, "buy").otherwise("hold")
    rows = V.returns(spark, d).select(rating.alias("rating"), *[(F.lead("close", n).over(by_ticker()) / F.col("close") - 1).alias(f"f{n}") for n in spans])
    hits = [six(F.avg(F.when(F.col(f"f{n}") > 0, 1.0).when(F.col(f"f{n}") <= 0, 0.0))).alias(f"hit{n}") for n in spans]
    return rows.groupBy("rating").agg(F.count("*").alias("n"), *[six(F.avg(f"f{n}")).alias(f"f{n}") for n in spans], *hits)


@query(f"""WITH {V.RETS}, s AS (SELECT ticker, lead(ret) OVER ({_W}) AS nxt, close, {', '.join(f"CASE WHEN count(close) OVER {_n(n)} >= {n} THEN avg(close) OVER {_n(n)} END AS s{n}" for n in (20, 60, 120))} FROM rets),
u AS (SELECT unnest([{{'n': 20, 's': s20}}, {{'n': 60, 's': s60}}, {{'n': 120, 's': s120}}]) AS x, nxt, close FROM s)
SELECT CAST(x.n AS INTEGER) AS lookback, count(*) AS n, round(avg(nxt), 6) AS mean, round(avg(nxt) / nullif(stddev_samp(nxt), 0) * sqrt(252), 6) AS sharpe FROM u WHERE close > 1.001 * x.s AND nxt IS NOT NULL GROUP BY 1""")
def b20_parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A moving-average rule under three lookbacks, all scored in one pass."""
    spans = (20, 60, 120)
    cases = F.array(*[F.struct(F.lit(n).alias("lookback"), rolling(F.avg, F.col("close"), n).alias("mean")) for n in spans])
    rows = V.returns(spark, d).select("close", F.lead("ret").over(by_ticker()).alias("nxt"), cases.alias("cases"))
    rows = rows.select("close", "nxt", F.explode("cases").alias("c")).where("close > 1.001 * c.mean AND nxt IS NOT NULL")
    return rows.groupBy("c.lookback").agg(F.count("*").alias("n"), six(F.avg("nxt")).alias("mean"), six(ratio(F.avg("nxt"), F.stddev_samp("nxt")) * 252**0.5).alias("sharpe"))


@query(f"""WITH {V.RETS}, t AS (SELECT ticker, exp(sum(ln(1 + ret))) - 1 AS total, max(date) AS last FROM rets GROUP BY 1), e AS (SELECT max(last) AS end_ FROM t)
SELECT count(*) AS tickers, count(*) FILTER (last < end_ - 30) AS gone, round(avg(total), 6) AS mean, round(avg(total) - 0.5 * count(*) FILTER (last < end_ - 30) / count(*), 6) AS adjusted FROM t, e""")
def b14_survivorship(spark: SparkSession, d: str) -> DataFrame:
    """Tickers without bars in the last month lose half of their worth."""
    t = V.returns(spark, d).groupBy("ticker").agg((F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("total"), F.max("date").alias("last"))
    out = t.groupBy("last").agg(F.count("*").alias("n"), F.sum("total").alias("s"))  # a row a date
    out = out.join(F.broadcast(out.agg(F.max("last").alias("end"))))
    gone = F.sum(F.when(F.col("last") < F.date_sub("end", 30), F.col("n")).otherwise(0))
    return out.agg(F.sum("n").alias("tickers"), gone.alias("gone"), six(F.sum("s") / F.sum("n")).alias("mean"), six(F.sum("s") / F.sum("n") - 0.5 * gone / F.sum("n")).alias("adjusted"))


@query(f"""WITH {V.MARKET}, l AS (SELECT date, mkt, exp(sum(ln(1 + mkt)) OVER (ORDER BY date)) AS level FROM market), w AS (SELECT *, level / avg(level) OVER (ORDER BY date ROWS 199 PRECEDING) - 1 AS dev, stddev_samp(mkt) OVER (ORDER BY date ROWS 59 PRECEDING) * sqrt(252) AS vol,
level / max(level) OVER (ORDER BY date) - 1 AS dd, row_number() OVER (ORDER BY date) AS k FROM l), s AS (SELECT date, least(1, greatest(0, (dev + 0.1) / 0.3)) * 100 AS s1, least(1, greatest(0, (vol - 0.05) / 0.35)) * 100 AS s2, least(1, greatest(0, -dd / 0.3)) * 100 AS s3 FROM w WHERE k >= 200)
SELECT date, round(0.4 * s1 + 0.3 * s2 + 0.3 * s3, 4) AS score, CASE WHEN 0.4 * s1 + 0.3 * s2 + 0.3 * s3 > 70 THEN 'extreme' WHEN 0.4 * s1 + 0.3 * s2 + 0.3 * s3 > 50 THEN 'elevated' WHEN 0.4 * s1 + 0.3 * s2 + 0.3 * s3 > 30 THEN 'normal' ELSE 'low' END AS rating FROM s""")
def x23_market_risk(spark: SparkSession, d: str) -> DataFrame:
    """Deviation from the 200-day mean, volatility and drawdown of the market's level, scored and weighted: a row a day."""
    from tidemark.functions.exprs import interp

    mkt = V.market(V.returns(spark, d))
    w = Window.orderBy("date")
    rows = mkt.join(index_level(mkt, "mkt"), "date").select(
        "date", (F.col("level") / F.avg("level").over(w.rowsBetween(-199, 0)) - 1).alias("dev"), (F.stddev_samp("mkt").over(w.rowsBetween(-59, 0)) * 252**0.5).alias("vol"),
        (F.col("level") / F.max("level").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("dd"), F.row_number().over(w).alias("k"),
    ).where("k >= 200")
    score = 0.4 * interp(F.col("dev"), -0.1, 0.2) + 0.3 * interp(F.col("vol"), 0.05, 0.40) + 0.3 * interp(-F.col("dd"), 0.0, 0.3)
    return rows.select("date", F.round(score, 4).alias("score"), F.when(score > 70, "extreme").when(score > 50, "elevated").when(score > 30, "normal").otherwise("low").alias("rating"))


@query(None)
def b21_genetic_search(spark: SparkSession, d: str) -> DataFrame:
    """The factor weights of best yearly ratio over the monthly returns that the factors earned; every generation's individuals."""
    z = ["vsm", "bab", "mom"]
    rows = panel(spark, d).select("as_of", "ticker", *[X.z_score(c, "as_of").alias(c) for c in z])
    ends = R.latest(V.bars(spark, d).withColumn("as_of", F.last_day("date")), ["ticker", "as_of"], "date")
    after = ends.select("ticker", "as_of", (F.lead("close").over(Window.partitionBy("ticker").orderBy("as_of")) / F.col("close") - 1).alias("target"))
    out = E.evolved(E.factor_returns(rows.join(after, ["as_of", "ticker"]), "as_of", z, "target"), [(-1.0, 1.0)] * 3)
    return out.select("generation", "k", *[six(F.get("genes", F.lit(j))).alias(c) for j, c in enumerate(z)], six(F.col("fitness")).alias("fitness"))


_SPANS = (20, 60, 120)


@query(f"""WITH {V.RETS}, s AS (SELECT date, lead(ret) OVER ({_W}) AS nxt, close, {', '.join(f"CASE WHEN count(close) OVER {_n(n)} >= {n} THEN avg(close) OVER {_n(n)} END AS s{n}" for n in _SPANS)} FROM rets),
u AS (SELECT year(date) AS year, unnest([{', '.join(f"{{'n': {n}, 's': s{n}}}" for n in _SPANS)}]) AS x, nxt, close FROM s), y AS (SELECT year, x.n AS lookback, sum(nxt) AS total, count(*) AS n FROM u WHERE close > 1.001 * x.s AND nxt IS NOT NULL GROUP BY 1, 2),
f AS (SELECT year, lookback, total, n, sum(total) OVER p / sum(n) OVER p AS trained, count(*) OVER p AS years FROM y WINDOW p AS (PARTITION BY lookback ORDER BY year RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(trained, 9) DESC, lookback) AS k FROM f WHERE years = 2)
SELECT CAST(year AS INTEGER) AS year, CAST(lookback AS INTEGER) AS lookback, round(trained, 6) AS trained, round(total / n, 6) AS tested FROM k WHERE k = 1""")
def b17_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each year the lookback that was best over the two years before, and what it gives in the year itself.

    Sums by year and lookback come from one pass over the bars; windows of years are windows over those few rows.
    """
    from pyspark.sql import Window

    cases = F.array(*[F.struct(F.lit(n).alias("lookback"), rolling(F.avg, F.col("close"), n).alias("mean")) for n in _SPANS])
    rows = V.returns(spark, d).select(F.year("date").alias("year"), "close", F.lead("ret").over(by_ticker()).alias("nxt"), cases.alias("cases"))
    rows = rows.select("year", "close", "nxt", F.explode("cases").alias("c")).where("close > 1.001 * c.mean AND nxt IS NOT NULL")
    years = rows.groupBy("year", "c.lookback").agg(F.sum("nxt").alias("total"), F.count("*").alias("n"))
    before = Window.partitionBy("lookback").orderBy("year").rangeBetween(-2, -1)
    trained = years.select("*", F.try_divide(F.sum("total").over(before), F.sum("n").over(before)).alias("trained"), F.count("*").over(before).alias("years")).where("years = 2")
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc(F.round("trained", 9)), "lookback"))
    best = trained.withColumn("k", place).where("k = 1")
    return best.select("year", "lookback", six(F.col("trained")).alias("trained"), six(F.col("total") / F.col("n")).alias("tested"))
