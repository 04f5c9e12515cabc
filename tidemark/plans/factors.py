"""Windows and alpha factors over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, ratio, six
from tidemark.functions.windows import ENDING, by_ticker, change, filled, last_n, placed, rank_share, recent, rolled, rolling, so_far, whole
from tidemark.operators import factors as A
from tidemark.operators import relational as R
from tidemark.plans.registry import query, sixes
from tidemark.sources import views as V

_W = "PARTITION BY ticker ORDER BY date"


def _n(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _last(rows: DataFrame, *columns: str) -> DataFrame:
    """ticker and the columns of each ticker's last row."""
    return rows.groupBy("ticker").agg(F.max(F.struct("date", *columns)).alias("r")).select("ticker", *[six(F.col(f"r.{c}")).alias(c) for c in columns])


def _ends(rows: DataFrame, **columns: Column) -> DataFrame:
    """ticker and the columns, aggregates that tell each ticker's last row."""
    return rows.groupBy("ticker").agg(*[six(x).alias(n) for n, x in columns.items()])


def _sql_last(inner: str, *columns: str) -> str:
    return f"SELECT ticker, {sixes(*columns)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k_ FROM ({inner})) WHERE k_ = 1"


@query(f"WITH {V.RETS} SELECT ticker, date, round(ret, 6) AS ret FROM rets")
def w01_daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return V.returns(spark, d).select("ticker", "date", six(F.col("ret")).alias("ret"))


@query(f"""WITH {V.BARS} SELECT ticker, date, round(close / nullif(lag(close, 21) OVER ({_W}), 0) - 1, 6) AS chg FROM bars""")
def w02_change_21(spark: SparkSession, d: str) -> DataFrame:
    return V.bars(spark, d).select("ticker", "date", six(change(F.col("close"), 21)).alias("chg"))


@query(f"""WITH {V.BARS}, w AS (SELECT ticker, date, {', '.join(f"CASE WHEN count(close) OVER {_n(n)} >= {n} THEN avg(close) OVER {_n(n)} END AS sma{n}" for n in (14, 130, 200))} FROM bars)
SELECT ticker, date, {sixes('sma14', 'sma130', 'sma200')} FROM w""")
def w07_moving_averages(spark: SparkSession, d: str) -> DataFrame:
    return V.bars(spark, d).select("ticker", "date", *[six(rolling(F.avg, F.col("close"), n)).alias(f"sma{n}") for n in (14, 130, 200)])


@query(f"""WITH {V.RETS} SELECT ticker, date, round(CASE WHEN count(ret) OVER {_n(20)} >= 5 THEN stddev_samp(ret) OVER {_n(20)} END, 6) AS sd20,
round(sum(volume) OVER {_n(14)}, 6) AS vol14, round(min(low) OVER {_n(20)}, 6) AS low20, round(max(high) OVER {_n(252)}, 6) AS high252 FROM rets""")
def w08_rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.returns(spark, d).select(
        "ticker", "date", six(rolling(F.stddev_samp, F.col("ret"), 20, 5)).alias("sd20"), six(F.sum("volume").over(last_n(14))).alias("vol14"),
        six(F.min("low").over(last_n(20))).alias("low20"), six(F.max("high").over(last_n(252))).alias("high252"),
    )


@query(f"""WITH {V.RETS}, g AS (SELECT ticker, date, exp(sum(ln(1 + coalesce(ret, 0))) OVER ({_W})) AS growth FROM rets),
p AS (SELECT *, max(growth) OVER ({_W}) AS peak FROM g)
SELECT ticker, date, round(growth, 6) AS growth, round(growth / peak - 1, 6) AS drawdown, round(min(growth / peak - 1) OVER ({_W}), 6) AS worst FROM p""")
def w13_growth_and_drawdown(spark: SparkSession, d: str) -> DataFrame:
    rows = V.returns(spark, d).select("ticker", "date", F.exp(F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0)))).over(so_far())).alias("growth"))
    rows = rows.withColumn("drawdown", F.col("growth") / F.max("growth").over(so_far()) - 1)
    return rows.select("ticker", "date", six(F.col("growth")).alias("growth"), six(F.col("drawdown")).alias("drawdown"), six(F.min("drawdown").over(so_far())).alias("worst"))


@query(f"""WITH {V.RETS} SELECT ticker, date, round(ret - lag(ret) OVER ({_W}), 6) AS diff, round((close - lag(close, 5) OVER ({_W})) / 5, 6) AS slope5,
CAST(CASE WHEN lag(ret) OVER ({_W}) <= 0 AND ret > 0 THEN 1 WHEN lag(ret) OVER ({_W}) >= 0 AND ret < 0 THEN -1 ELSE 0 END AS INTEGER) AS crossed FROM rets""")
def w15_slopes_and_crossings(spark: SparkSession, d: str) -> DataFrame:
    was = F.lag("ret").over(by_ticker())
    crossed = F.when((was <= 0) & (F.col("ret") > 0), 1).when((was >= 0) & (F.col("ret") < 0), -1).otherwise(0)
    return V.returns(spark, d).select(
        "ticker", "date", six(F.col("ret") - was).alias("diff"), six((F.col("close") - F.lag("close", 5).over(by_ticker())) / 5).alias("slope5"), crossed.alias("crossed")
    )


_HOLES = f"""{V.BARS}, holes AS (SELECT ticker, date, CASE WHEN (date - DATE '1970-01-01') % 7 IN (0, 3) THEN NULL ELSE close END AS px, row_number() OVER ({_W}) AS k FROM bars)"""


def _holes(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff("date", F.lit("1970-01-01").cast("date"))
    return V.bars(spark, d).select("ticker", "date", F.when(~(days % 7).isin(0, 3), F.col("close")).alias("px"), F.row_number().over(by_ticker()).alias("k"))


@query(f"""WITH {_HOLES} SELECT ticker, date, round(last_value(px IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 6) AS forward,
round(first_value(px IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS back FROM holes""")
def w16_fills(spark: SparkSession, d: str) -> DataFrame:
    after = by_ticker().rowsBetween(0, Window.unboundedFollowing)
    return _holes(spark, d).select("ticker", "date", six(filled(F.col("px"))).alias("forward"), six(F.first("px", ignorenulls=True).over(after)).alias("back"))


@query(f"""WITH {_HOLES}, e AS (SELECT *, last_value(px IGNORE NULLS) OVER a AS p0, last_value(CASE WHEN px IS NOT NULL THEN k END IGNORE NULLS) OVER a AS k0,
first_value(px IGNORE NULLS) OVER b AS p1, first_value(CASE WHEN px IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k1 FROM holes
WINDOW a AS ({_W} ROWS UNBOUNDED PRECEDING), b AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ticker, date, round(coalesce(px, p0 + (p1 - p0) * (k - k0) / nullif(k1 - k0, 0)), 6) AS px FROM e""")
def w17_linear_interpolation(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.quality import interpolated

    return interpolated(_holes(spark, d), "px").select("ticker", "date", six(F.col("px")).alias("px"))


@query(f"""WITH RECURSIVE {V.RETS}, n AS (SELECT ticker, ret, row_number() OVER ({_W}) AS k FROM rets WHERE ret IS NOT NULL),
e AS (SELECT ticker, k, 1.0::DOUBLE AS sw, 1.0::DOUBLE AS sw2, ret AS m, 0.0::DOUBLE AS s FROM n WHERE k = 1
UNION ALL SELECT n.ticker, n.k, e.sw*(1-2/21.0)+1, e.sw2*pow(1-2/21.0,2)+1, e.m+(n.ret-e.m)/(e.sw*(1-2/21.0)+1),
e.s*(1-2/21.0)+(n.ret-e.m)*(n.ret-(e.m+(n.ret-e.m)/(e.sw*(1-2/21.0)+1))) FROM e JOIN n ON n.ticker=e.ticker AND n.k=e.k+1)
SELECT ticker, round(sqrt(s/sw * sw*sw/nullif(sw*sw-sw2,0)), 6) AS ewm_vol FROM e QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC) = 1""")
def w18_ewm_volatility(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.state import ewm_std

    return ewm_std(V.returns(spark, d).where("ret IS NOT NULL"), "ret", 20).select("ticker", six(F.col("ewm_std")).alias("ewm_vol"))


@query(f"""WITH RECURSIVE {V.RETS}, n AS (SELECT ticker, ret, row_number() OVER ({_W}) AS k FROM rets WHERE ret IS NOT NULL),
e AS (SELECT ticker, k, ret AS ema FROM n WHERE k = 1 UNION ALL SELECT n.ticker, n.k, 0.94 * e.ema + 0.06 * n.ret FROM e JOIN n ON n.ticker = e.ticker AND n.k = e.k + 1)
SELECT ticker, round(ema, 6) AS ema FROM e QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC) = 1""")
def w19_recursive_mean(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.state import ema

    return ema(V.returns(spark, d).where("ret IS NOT NULL"), "ret", 0.06).select("ticker", six(F.col("ema")).alias("ema"))


@query(f"""WITH {V.RETS}, f AS (SELECT ticker, date, ret, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY ticker, year(date) ORDER BY date)) - 1 AS cum FROM rets)
SELECT ticker, CAST(year(date) AS INTEGER) AS year, min(date) FILTER (cum <= -0.15) AS stopped_on, round(min(cum), 6) AS worst FROM f GROUP BY 1, 2""")
def w20_stop_loss(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("ticker", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = V.returns(spark, d).select("ticker", "date", (F.exp(F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0)))).over(w)) - 1).alias("cum"))
    return rows.groupBy("ticker", F.year("date").alias("year")).agg(F.min(F.when(F.col("cum") <= -0.15, F.col("date"))).alias("stopped_on"), six(F.min("cum")).alias("worst"))


_SWINGS = f"""f AS (SELECT *, count(*) OVER n AS full_, max(high) OVER n AS nh, min(low) OVER n AS nl, max(high) OVER t AS th, min(low) OVER t AS tl FROM rets
WINDOW n AS ({_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), t AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
swings AS (SELECT *, high = nh AS swing_high, low = nl AS swing_low FROM f WHERE full_ = 11 AND (th - tl) / tl >= 0.02 AND (high = nh OR low = nl))"""


@query(f"WITH {V.RETS}, {_SWINGS} SELECT ticker, date, swing_high, swing_low FROM swings")
def w21_swings(spark: SparkSession, d: str) -> DataFrame:
    return A.swings(V.returns(spark, d)).select("ticker", "date", "swing_high", "swing_low")


@query(f"""WITH {V.BARS}, g AS (SELECT ticker, date, CASE WHEN date - lag(date) OVER ({_W}) <= 3 THEN 0 ELSE 1 END AS opens FROM bars),
i AS (SELECT *, sum(opens) OVER ({_W}) AS island FROM g) SELECT ticker, CAST(island AS BIGINT) AS island, min(date) AS first_date, max(date) AS last_date, count(*) AS bars FROM i GROUP BY 1, 2""")
def w22_islands(spark: SparkSession, d: str) -> DataFrame:
    gap = F.datediff("date", F.lag("date").over(by_ticker()))
    rows = V.bars(spark, d).withColumn("opens", F.when(gap <= 3, 0).otherwise(1)).withColumn("island", F.sum("opens").over(so_far()))
    return rows.groupBy("ticker", "island").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("bars"))


@query(f"""WITH {V.MARKET}, j AS (SELECT r.*, mkt FROM rets r JOIN market USING (date) WHERE ret IS NOT NULL)
SELECT ticker, date, round(CASE WHEN count(*) OVER {_n(252)} >= 126 THEN covar_samp(ret, mkt) OVER {_n(252)} / nullif(var_samp(mkt) OVER {_n(252)}, 0) ELSE 1.0 END, 6) AS beta FROM j""")
def w27_rolling_beta(spark: SparkSession, d: str) -> DataFrame:
    ret, mkt = F.col("ret"), F.col("mkt")
    rows = rolled(_with_market(spark, d), 252, n=F.lit(1.0), r=ret, m=mkt, mm=mkt * mkt, rm=ret * mkt)
    cov, var = F.col("rm") - F.col("r") * F.col("m") / F.col("n"), F.col("mm") - F.col("m") * F.col("m") / F.col("n")
    return rows.select("ticker", "date", six(F.when(F.col("n") >= 126, ratio(cov, var)).otherwise(1.0)).alias("beta"))


def _with_market(spark: SparkSession, d: str) -> DataFrame:
    """Returns beside the day's mean: aggregated partially, a row a day is joined back."""
    rets = V.returns(spark, d).where("ret IS NOT NULL")
    return rets.join(V.market(rets), "date")


@query(f"""WITH {V.RETS}, l AS (SELECT ticker, date, ret FROM rets WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY ret DESC, ticker) > 0)
SELECT ticker, date, round((rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0) / count(*) OVER (PARTITION BY date), 6) AS pct,
round(100 * cume_dist() OVER (PARTITION BY date ORDER BY ret), 6) AS upto FROM l""")
def w05_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("date").orderBy("ret")
    return V.returns(spark, d).where("ret IS NOT NULL").select("ticker", "date", six(rank_share(F.col("ret"), "date")).alias("pct"), six(100 * F.cume_dist().over(w)).alias("upto"))


@query(f"""WITH {V.BARS}, s AS (SELECT ticker, date, close / avg(close) OVER {_n(200)} - 1 AS dev, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, count(close) OVER {_n(200)} AS c FROM bars),
l AS (SELECT ticker, dev AS last FROM s WHERE k = 1) SELECT ticker, round(avg(CASE WHEN dev < last THEN 1.0 ELSE 0 END), 6) AS percentile FROM s JOIN l USING (ticker) WHERE c >= 200 GROUP BY 1""")
def w31_deviation_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = V.bars(spark, d).select("ticker", "date", (ratio(F.col("close"), rolling(F.avg, F.col("close"), 200)) - 1).alias("dev"))
    rows = rows.withColumn("last", F.max_by("dev", "date").over(whole("ticker"))).where("dev IS NOT NULL")
    return rows.groupBy("ticker").agg(six(F.avg((F.col("dev") < F.col("last")).cast("double"))).alias("percentile"))


@query(_sql_last(f"""WITH {V.RETS} SELECT ticker, date, CASE WHEN count(close) OVER {_n(252)} >= 252 THEN least(1, greatest(0, (close / max(close) OVER {_n(252)} - 0.7) / 0.3)) * 100 END AS high_mom,
coalesce((close / nullif(lag(close, 252) OVER ({_W}), 0) - 1) / nullif(CASE WHEN count(ret) OVER {_n(252)} >= 252 THEN stddev_samp(ret) OVER {_n(252)} END * sqrt(252), 0), 0) AS vsm,
CASE WHEN count(close) OVER {_n(253)} >= 253 THEN (lag(close, 20) OVER ({_W}) / lag(close, 251) OVER ({_W}) - 1) * 0.12 / nullif(stddev_pop(ret) OVER {_n(60)} * sqrt(252), 0) END AS vsm_target,
CASE WHEN count(ret) OVER {_n(252)} >= 252 THEN (exp(sum(ln(1 + ret)) OVER {_n(252)}) - 1) / nullif(stddev_samp(ret) OVER {_n(252)} * sqrt(252), 0) END AS vsm_total,
close / lag(close, 251) OVER ({_W}) - close / lag(close, 20) OVER ({_W}) AS mom_diff, lag(close, 20) OVER ({_W}) / lag(close, 251) OVER ({_W}) - 1 AS mom_12m,
close / lag(close, 125) OVER ({_W}) - 1 AS mom_6m, CASE WHEN count(ret) OVER {_n(59)} >= 59 THEN stddev_samp(ret) OVER {_n(59)} END * sqrt(252) AS vol_60d,
1e6 * avg(abs(ret) / nullif(close * volume, 0)) OVER {_n(21)} AS amihud, close / CASE WHEN count(close) OVER {_n(130)} >= 130 THEN avg(close) OVER {_n(130)} END AS levy FROM rets""",
    "high_mom", "vsm", "vsm_target", "vsm_total", "mom_diff", "mom_12m", "mom_6m", "vol_60d", "amihud", "levy"))
def f01_price_factor_panel(spark: SparkSession, d: str) -> DataFrame:
    """F01-F04, F08-F11, F21 and F37 in one pass."""
    at = ENDING
    return _ends(
        placed(V.returns(spark, d), 253), high_mom=A.high_momentum(at), vsm=A.vol_scaled_momentum(at), vsm_target=A.vol_targeted_momentum(at), vsm_total=A.vol_scaled_total(at),
        mom_diff=A.momentum_difference(at), mom_12m=A.momentum_12m(at), mom_6m=A.momentum_6m(at), vol_60d=A.volatility_60d(at), amihud=A.amihud(at), levy=A.levy(at=at),
    )


@query(_sql_last(f"""WITH {V.MARKET}, j AS (SELECT r.*, mkt FROM rets r JOIN market USING (date) WHERE ret IS NOT NULL) SELECT ticker, date,
CASE WHEN count(ret) OVER {_n(252)} >= 200 THEN -covar_samp(ret, mkt) OVER {_n(252)} / nullif(var_samp(mkt) OVER {_n(252)}, 0) END AS bab,
CASE WHEN count(ret) OVER {_n(252)} >= 200 THEN -covar_samp(ret, mkt) OVER {_n(252)} / nullif(var_pop(mkt) OVER {_n(252)}, 0) END AS bab_mixed,
1 - covar_samp(ret, mkt) OVER {_n(252)} / nullif(var_pop(mkt) OVER {_n(252)}, 0) AS one_less_beta,
CASE WHEN count(ret) OVER {_n(21)} >= 21 THEN -sqrt(greatest(var_pop(ret) OVER {_n(21)} * (1 - pow(corr(ret, mkt) OVER {_n(21)}, 2)), 0)) * sqrt(252) END AS ivol FROM j""",
    "bab", "bab_mixed", "one_less_beta", "ivol"))
def f05_market_factor_panel(spark: SparkSession, d: str) -> DataFrame:
    """F05-F07 and F20."""
    at = ENDING
    beta = ratio(at.over(252, F.covar_samp, "ret", "mkt"), at.over(252, F.var_pop, "mkt"))
    rows = placed(_with_market(spark, d), 252)
    return _ends(rows, bab=A.betting_against_beta(at=at), bab_mixed=A.betting_against_beta(True, at), one_less_beta=1 - beta, ivol=A.idiosyncratic_vol(at))


_FLOWS = f"""t AS (SELECT *, (high + low + close) / 3 AS typical FROM rets), u AS (SELECT *, lag(typical) OVER ({_W}) AS was FROM t),
flows AS (SELECT *, CAST(row_number() OVER ({_W}) AS DOUBLE) AS k, CASE WHEN typical > was THEN typical * volume ELSE 0 END AS up, CASE WHEN typical < was THEN typical * volume ELSE 0 END AS down,
sum(CASE WHEN ret IS NULL THEN 0 ELSE sign(ret) * volume END) OVER ({_W}) AS obv FROM u),
mfi AS (SELECT *, CASE WHEN k <= 14 THEN 50.0 WHEN sum(down) OVER {_n(14)} = 0 THEN CASE WHEN sum(up) OVER {_n(14)} = 0 THEN 50.0 ELSE 100.0 END
ELSE 100 - 100 / (1 + sum(up) OVER {_n(14)} / sum(down) OVER {_n(14)}) END AS mfi,
CASE WHEN count(obv) OVER {_n(252)} >= 20 THEN least(5, greatest(-5, coalesce((obv - avg(obv) OVER {_n(252)}) / nullif(stddev_samp(obv) OVER {_n(252)}, 0), 0))) ELSE 0 END AS obv_z,
CASE WHEN count(obv) OVER {_n(20)} >= 20 THEN covar_pop(k, obv) OVER {_n(20)} / nullif(var_pop(k) OVER {_n(20)}, 0) / nullif(avg(abs(obv)) OVER {_n(20)}, 0) END AS obv_slope FROM flows)"""


def _flow_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = A.with_flows(V.returns(spark, d))
    return rows.select("*", A.money_flow_index().alias("mfi"), A.obv_z().alias("obv_z"), A.obv_trend()[0].alias("obv_slope"))


def _flow_ends(spark: SparkSession, d: str) -> DataFrame:
    """ticker, mfi, obv, obv_z and obv_slope of each ticker's last row."""
    rows = placed(A.with_flows(V.returns(spark, d)).withColumn("mfi", A.money_flow_index()), A.YEAR)
    last = {"mfi": ENDING.now("mfi"), "obv": ENDING.now("obv"), "obv_z": A.obv_z(ENDING), "obv_slope": A.obv_trend(at=ENDING)[0]}
    return rows.groupBy("ticker").agg(*[x.alias(n) for n, x in last.items()])


@query(_sql_last(f"WITH {V.RETS}, {_FLOWS} SELECT ticker, date, mfi, obv, obv_z, obv_slope FROM mfi", "mfi", "obv", "obv_z", "obv_slope"))
def f28_money_flow(spark: SparkSession, d: str) -> DataFrame:
    """F28-F30."""
    return _flow_ends(spark, d).select("ticker", *[six(F.col(c)).alias(c) for c in ("mfi", "obv", "obv_z", "obv_slope")])


@query(f"""WITH {V.RETS}, {_FLOWS} SELECT ticker, date, CASE WHEN mfi < 20 THEN 'oversold' WHEN mfi > 80 THEN 'overbought' ELSE 'neutral' END AS class,
CASE WHEN obv_slope > 0.01 THEN 'rising' WHEN obv_slope < -0.01 THEN 'falling' ELSE 'flat' END AS trend FROM mfi""")
def h08_flow_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _flow_rows(spark, d)
    kind = F.when(F.col("mfi") < 20, "oversold").when(F.col("mfi") > 80, "overbought").otherwise("neutral")
    trend = F.when(F.col("obv_slope") > 0.01, "rising").when(F.col("obv_slope") < -0.01, "falling").otherwise("flat")
    return rows.select("ticker", "date", kind.alias("class"), trend.alias("trend"))


def _div_sql(flag: str, price: str, kind: str, sign: str) -> str:
    other = "<" if sign == ">" else ">"
    return f"""SELECT ticker, '{kind}' AS kind, round(least(1, (abs(dp) + abs(di)) / 0.1), 6) AS confidence FROM (SELECT ticker, (p1 - p2) / nullif(abs(p2), 0) AS dp, (i1 - i2) / nullif(abs(i2), 0) AS di FROM (
SELECT ticker, max(CASE WHEN n=1 THEN {price} END) AS p1, max(CASE WHEN n=2 THEN {price} END) AS p2, max(CASE WHEN n=1 THEN mfi END) AS i1, max(CASE WHEN n=2 THEN mfi END) AS i2
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM swings WHERE {flag}) WHERE n <= 2 GROUP BY 1)) WHERE dp {other} 0 AND di {sign} 0"""


@query(f"""WITH {V.RETS}, {_FLOWS}, {_SWINGS.replace('FROM rets', 'FROM mfi')} {_div_sql('swing_low', 'low', 'bullish', '>')} UNION ALL {_div_sql('swing_high', 'high', 'bearish', '<')}""")
def f32_divergences(spark: SparkSession, d: str) -> DataFrame:
    """F31 and F32."""
    return A.divergences(A.swings(_flow_rows(spark, d)), "mfi").withColumn("confidence", six(F.col("confidence")))


@query(f"""WITH {V.RETS}, {_FLOWS}, {_SWINGS.replace('FROM rets', 'FROM mfi')}, dv AS ({_div_sql('swing_low', 'low', 'bullish', '>')} UNION ALL {_div_sql('swing_high', 'high', 'bearish', '<')}),
sc AS (SELECT ticker, sum(CASE WHEN kind = 'bullish' THEN confidence ELSE -confidence END) AS div FROM dv GROUP BY 1),
l AS (SELECT ticker, mfi, obv_z FROM mfi QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
SELECT ticker, round(least(1, greatest(-1, 0.25 * (mfi - 50) / 50 + 0.25 * obv_z / 5 + 0.5 * coalesce(div, 0))), 5) AS score FROM l LEFT JOIN sc USING (ticker)""")
def f34_money_flow_score(spark: SparkSession, d: str) -> DataFrame:
    """F33, F34."""
    rows = _flow_rows(spark, d)
    signed = F.when(F.col("kind") == "bullish", six(F.col("confidence"))).otherwise(-six(F.col("confidence")))
    div = A.divergences(A.swings(rows), "mfi").groupBy("ticker").agg(F.sum(signed).alias("div"))
    last = _flow_ends(spark, d).select("ticker", "mfi", "obv_z")
    score = 0.25 * (F.col("mfi") - 50) / 50 + 0.25 * F.col("obv_z") / 5 + 0.5 * F.coalesce("div", F.lit(0.0))
    return last.join(div, "ticker", "left").select("ticker", F.round(clip(score, -1.0, 1.0), 5).alias("score"))


_SECTOR = f"""WITH {V.BARS}, {V.SECURITY}, m AS (SELECT ticker, sector, CAST(date_trunc('week', date) AS DATE) AS date, arg_max(close, date) AS close FROM bars JOIN security USING (ticker) GROUP BY 1, 2, 3),
s AS (SELECT sector, date, avg(close) AS price FROM m GROUP BY 1, 2), b AS (SELECT date, avg(close) AS base FROM m GROUP BY 1), p AS (SELECT sector, date, price / nullif(base, 0) AS raw,
row_number() OVER (PARTITION BY sector ORDER BY date) AS k FROM s JOIN b USING (date)),
q AS (SELECT *, avg(CASE WHEN k <= 14 THEN raw END) OVER (PARTITION BY sector) AS first_ FROM p),
r AS (SELECT sector, date, CASE WHEN k >= 14 THEN 100 * avg(raw / first_) OVER (PARTITION BY sector ORDER BY date ROWS 13 PRECEDING) END AS ratio FROM q),
z AS (SELECT *, 100 * ratio / lag(ratio, 14) OVER (PARTITION BY sector ORDER BY date) AS momentum FROM r),
rrg AS (SELECT *, CASE WHEN ratio >= 100 AND momentum >= 100 THEN 'leading' WHEN ratio >= 100 THEN 'weakening' WHEN momentum >= 100 THEN 'improving' ELSE 'lagging' END AS quadrant FROM z WHERE momentum IS NOT NULL)"""


def _rrg(spark: SparkSession, d: str) -> DataFrame:
    weekly = R.resampled(V.bars(spark, d), "week").join(V.security(spark, d).select("ticker", "sector"), "ticker")
    sectors = weekly.groupBy("sector", "date").agg(F.avg("close").alias("price"))
    return A.relative_rotation(sectors.join(weekly.groupBy("date").agg(F.avg("close").alias("base")), "date"))


@query(f"""{_SECTOR} SELECT sector, date, round(ratio, 4) AS ratio, round(momentum, 4) AS momentum FROM rrg""")
def f35_relative_rotation(spark: SparkSession, d: str) -> DataFrame:
    return _rrg(spark, d).select("sector", "date", F.round("ratio", 4).alias("ratio"), F.round("momentum", 4).alias("momentum"))


@query(f"""{_SECTOR}, l AS (SELECT *, lag(quadrant) OVER (PARTITION BY sector ORDER BY date) AS before, row_number() OVER (PARTITION BY sector ORDER BY date DESC) AS k FROM rrg)
SELECT sector, quadrant, before, CASE quadrant WHEN 'leading' THEN 1.0 WHEN 'improving' THEN 0.5 WHEN 'weakening' THEN -0.5 ELSE -1.0 END::DOUBLE AS score FROM l WHERE k = 1""")
def h11_sector_quadrants(spark: SparkSession, d: str) -> DataFrame:
    """F35's last quadrant of each sector, with H09, H11 and H27."""
    return R.latest(_rrg(spark, d), ["sector"], "date").select("sector", "quadrant", "before", "score")


@query(_sql_last(f"""WITH {V.MARKET}, lv AS (SELECT date, exp(sum(ln(1 + mkt)) OVER (ORDER BY date)) AS level FROM market), j AS (SELECT b.ticker, b.date, close / nullif(level, 0) AS rs FROM bars b JOIN lv USING (date)),
m AS (SELECT *, 100 * (rs / CASE WHEN count(rs) OVER {_n(252)} >= 252 THEN avg(rs) OVER {_n(252)} END - 1) AS mansfield FROM j)
SELECT ticker, date, mansfield, (mansfield - lag(mansfield, 5) OVER ({_W})) / 5 AS slope5 FROM m""", "mansfield", "slope5"))
def f38_mansfield(spark: SparkSession, d: str) -> DataFrame:
    rets = V.returns(spark, d)
    from tidemark.operators.backtest import index_level

    rows = rets.select("ticker", "date", "close").join(index_level(V.market(rets), "mkt"), "date")
    return _last(A.with_mansfield(recent(rows, A.YEAR + 6)), "mansfield", "slope5")


@query(f"""WITH {V.RETS}, v AS (SELECT *, CASE WHEN count(volume) OVER {_n(20)} >= 5 THEN coalesce((volume - avg(volume) OVER {_n(20)}) / nullif(stddev_samp(volume) OVER {_n(20)}, 0), 0) ELSE 0 END AS z,
low <= min(low) OVER {_n(20)} AS lows, high >= max(high) OVER {_n(20)} AS highs, (close - low) / nullif(high - low, 0) AS place FROM rets)
SELECT ticker, date, round(z, 6) AS z, CASE WHEN z > 2 AND lows AND place >= 0.75 THEN 'rejection' WHEN z > 2 AND abs(coalesce(ret, 0)) < 0.005 THEN 'absorption' WHEN z > 2 AND highs AND place <= 0.25 THEN 'distribution' ELSE 'none' END AS pattern FROM v""")
def f39_volume_structure(spark: SparkSession, d: str) -> DataFrame:
    z, pattern = A.volume_structure()
    return V.returns(spark, d).select("ticker", "date", six(z).alias("z"), pattern.alias("pattern"))


@query(f"""WITH {V.EDGES}, sides AS (SELECT supplier AS ticker, customer AS other, weight FROM edges UNION ALL SELECT customer, supplier, weight FROM edges), s0 AS (SELECT s_suppkey AS ticker, s_acctbal / 10000 AS v FROM supplier),
m1 AS (SELECT e.ticker, sum(weight * v) / sum(weight) AS m FROM sides e JOIN s0 ON e.other = s0.ticker GROUP BY 1), s1 AS (SELECT ticker, v + 0.5 * coalesce(m, 0) AS v FROM s0 LEFT JOIN m1 USING (ticker)),
m2 AS (SELECT e.ticker, sum(weight * v) / sum(weight) AS m FROM sides e JOIN s1 ON e.other = s1.ticker GROUP BY 1) SELECT ticker, round(v + 0.25 * coalesce(m, 0), 6) AS value FROM s1 LEFT JOIN m2 USING (ticker)""")
def f42_supply_chain_momentum(spark: SparkSession, d: str) -> DataFrame:
    signal = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), (F.col("s_acctbal") / 10000).alias("value"))
    return A.propagated(R.both_ways(V.edges(spark, d)), signal).select("ticker", six(F.col("value")).alias("value"))


@query(f"""WITH {V.RETS}, v AS (SELECT *, CASE WHEN count(ret) OVER {_n(20)} >= 20 THEN stddev_samp(ret) OVER {_n(20)} END AS vol, row_number() OVER ({_W}) AS k FROM rets),
h AS (SELECT a.ticker, a.date, a.close, a.vol, b.date AS bd, b.close AS bc, b.k - a.k AS ahead FROM v a JOIN v b ON a.ticker = b.ticker AND b.k BETWEEN a.k + 1 AND a.k + 20 WHERE a.vol IS NOT NULL)
SELECT ticker, date, CAST(coalesce(sign(arg_min(bc, ahead) FILTER (abs(bc / close - 1) >= 2 * vol) - any_value(close)), 0) AS INTEGER) AS label,
arg_min(bd, ahead) FILTER (abs(bc / close - 1) >= 2 * vol) AS touched, round(coalesce(arg_min(bc, ahead) FILTER (abs(bc / close - 1) >= 2 * vol), arg_max(bc, ahead)) / any_value(close) - 1, 6) AS ret FROM h GROUP BY 1, 2""")
def l01_triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    return A.triple_barrier(V.returns(spark, d)).withColumn("ret", six(F.col("ret")))
