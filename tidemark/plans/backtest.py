"""Portfolio, risk, execution and backtest measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import cdf_sql, ppf_sql, ratio, six
from tidemark.functions.windows import by_ticker, change, whole
from tidemark.operators import backtest as B
from tidemark.operators import engine as E
from tidemark.operators import portfolio as P
from tidemark.operators import relational as R
from tidemark.plans.registry import query, sixes
from tidemark.plans.xsec import _CLEAN, _PANEL, panel
from tidemark.operators import xsec as X
from tidemark.sources import views as V

_W = "PARTITION BY ticker ORDER BY date"


@query(f"""WITH {V.RETS}, g AS (SELECT ticker, date, ret, exp(sum(ln(1 + ret)) OVER ({_W})) AS g FROM rets WHERE ret IS NOT NULL), d AS (SELECT *, g / greatest(max(g) OVER ({_W}), 1) - 1 AS dd FROM g)
SELECT ticker, count(*) AS n, round(arg_max(g, date) - 1, 6) AS total, round(pow(arg_max(g, date), 252.0 / count(*)) - 1, 6) AS annual, round(stddev_samp(ret) * sqrt(252), 6) AS vol,
round((avg(ret) - 0.042 / 252) * sqrt(252) / nullif(stddev_samp(ret), 0), 6) AS sharpe, round(least(min(dd), 0), 6) AS max_drawdown, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM d GROUP BY 1""")
def b06_performance(spark: SparkSession, d: str) -> DataFrame:
    """B06, B11 and F45."""
    out = B.performance(V.returns(spark, d).where("ret IS NOT NULL"), "ticker", "date", "ret", 252, 0.042)
    return out.select("ticker", "n", *[six(F.col(c)).alias(c) for c in ("total", "annual", "vol", "sharpe", "max_drawdown", "hit_rate")])


@query(f"""WITH {V.MARKET}, j AS (SELECT r.ticker, ret, mkt FROM rets r JOIN market USING (date) WHERE ret IS NOT NULL), a AS (SELECT ticker, covar_samp(ret, mkt) / nullif(var_samp(mkt), 0) AS beta, avg(ret) AS r, avg(mkt) AS b, stddev_samp(ret - mkt) AS te, avg(ret - mkt) AS a, count(*) AS n FROM j GROUP BY 1)
SELECT ticker, round(beta, 6) AS beta, round((r - beta * b) * 252, 6) AS alpha, round(te * sqrt(252), 6) AS tracking_error, round(a * sqrt(252) / nullif(te, 0), 6) AS information_ratio FROM a WHERE n >= 20""")
def b12_against_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """B12, B13, H20 and H21."""
    rets = V.returns(spark, d).where("ret IS NOT NULL")
    out = B.against_benchmark(rets.join(V.market(rets), "date"), "ticker", "ret", "mkt")
    return out.select("ticker", *[six(F.col(c)).alias(c) for c in ("beta", "alpha", "tracking_error", "information_ratio")])


_LUCK = f"((1 - 0.5772156649015329) * {ppf_sql('0.9::DOUBLE')} + 0.5772156649015329 * {ppf_sql(f'{1 - 1 / (10 * 2.718281828459045)}::DOUBLE')})"


@query(f"""WITH {V.RETS}, m AS (SELECT ticker, ret, avg(ret) OVER (PARTITION BY ticker) AS mu FROM rets WHERE ret IS NOT NULL), s AS (SELECT ticker, count(*) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr,
avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS sk, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) AS ku FROM m GROUP BY 1), v AS (SELECT *, sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1)) AS sd FROM s)
SELECT ticker, round(sr, 6) AS sharpe, round({cdf_sql('sr / sd')}, 5) AS psr, round({cdf_sql(f'(sr - sd * {_LUCK}) / sd')}, 5) AS dsr FROM v""")
def b15_deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    out = B.sharpe_statistics(V.returns(spark, d).where("ret IS NOT NULL"), "ticker", "ret")
    return out.select("ticker", six(F.col("sharpe")).alias("sharpe"), F.round("psr", 5).alias("psr"), F.round("dsr", 5).alias("dsr"))


@query(f"""WITH {V.BARS}, p AS (SELECT ticker, date, row_number() OVER ({_W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars), f AS (SELECT *, CAST(unnest(range(5)) AS INTEGER) AS fold FROM p)
SELECT ticker, fold, CASE WHEN i >= floor(n*fold/5) AND i < floor(n*(fold+1)/5) THEN 'test' WHEN i < floor(n*fold/5) AND i + 20 > floor(n*fold/5) THEN 'purged'
WHEN i >= floor(n*(fold+1)/5) AND i < floor(n*(fold+1)/5) + floor(n*0.01) THEN 'embargo' ELSE 'train' END AS role, count(*) AS rows FROM f GROUP BY 1, 2, 3""")
def b16_purged_folds(spark: SparkSession, d: str) -> DataFrame:
    return B.purged_folds(V.bars(spark, d), "ticker").groupBy("ticker", "fold", "role").agg(F.count("*").alias("rows"))


_MONTHS = f"""{V.BARS}, p AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
mr AS (SELECT * FROM (SELECT ticker, month, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY month), 0) - 1 AS ret FROM p) WHERE ret IS NOT NULL)"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    rows = R.resampled(V.bars(spark, d), "month")
    return rows.select("ticker", "date", change(F.col("close")).alias("ret")).where("ret IS NOT NULL")


@query(f"""WITH {_MONTHS}, g AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS g, count(*) OVER w AS k FROM mr WINDOW w AS (PARTITION BY ticker ORDER BY month))
SELECT ticker, month, CAST(1000 + 100 * k AS DOUBLE) AS paid, round(g * (1000 + sum(100 * (1 + ret) / g) OVER (PARTITION BY ticker ORDER BY month)), 4) AS worth FROM g""")
def b18_dollar_cost_averaging(spark: SparkSession, d: str) -> DataFrame:
    out = B.dca(monthly(spark, d), "ticker", "date", "ret", 100.0, 1000.0)
    return out.select("ticker", F.col("date").alias("month"), six(F.col("paid")).alias("paid"), F.round("worth", 4).alias("worth"))


@query(f"""WITH {_MONTHS}, r AS (SELECT ticker, month, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s, count(*) OVER w AS n FROM mr WINDOW w AS (PARTITION BY ticker ORDER BY month ROWS 11 PRECEDING))
SELECT ticker, month, round(m * sqrt(12) / nullif(s, 0), 6) AS sharpe12 FROM r WHERE n = 12""")
def w25_rolling_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """B08 and W25."""
    w = by_ticker().rowsBetween(-11, 0)
    rows = monthly(spark, d).select("ticker", F.col("date").alias("month"), ratio(F.avg("ret").over(w) * 12**0.5, F.stddev_samp("ret").over(w)).alias("s"), F.count("*").over(w).alias("n"))
    return rows.where("n = 12").select("ticker", "month", six(F.col("s")).alias("sharpe12"))


@query(f"""WITH {_MONTHS} SELECT ticker, CAST(year(month) AS INTEGER) AS year, {', '.join(f"round(max(CASE WHEN month(month) = {m} THEN ret END), 6) AS m{m:02d}" for m in range(1, 13))}, round(exp(sum(ln(1 + ret))) - 1, 6) AS total FROM mr GROUP BY 1, 2""")
def b08_monthly_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = monthly(spark, d).groupBy("ticker", F.year("date").alias("year"))
    return rows.agg(*[six(F.max(F.when(F.month("date") == m, F.col("ret")))).alias(f"m{m:02d}") for m in range(1, 13)], six(F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("total"))


_SELECTED = f"""{_PANEL}, {_CLEAN}, sc AS (SELECT as_of, ticker, sector, round((z_vsm + z_bab + z_mom) / 3, 6) AS score FROM z),
s1 AS (SELECT *, row_number() OVER (PARTITION BY as_of, sector ORDER BY score DESC, ticker) AS s FROM sc), s2 AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) AS k FROM s1 WHERE s <= 6),
s3 AS (SELECT as_of, ticker, sector, least(0.05, 1.0 / count(*) OVER (PARTITION BY as_of)) AS w FROM s2 WHERE k <= 20), held AS (SELECT as_of, ticker, sector, w / sum(w) OVER (PARTITION BY as_of) AS weight FROM s3)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    z = X.winsorised(panel(spark, d), ["as_of"], ["vsm", "bab", "mom"]).select("as_of", "ticker", "sector", *[X.z_score(c, "as_of").alias(c) for c in ("vsm", "bab", "mom")])
    return z.select("as_of", "ticker", "sector", six((F.col("vsm") + F.col("bab") + F.col("mom")) / 3).alias("score"))


@query(f"""WITH {_SELECTED} SELECT as_of, ticker, sector, round(weight, 6) AS weight FROM held""")
def b02_selection(spark: SparkSession, d: str) -> DataFrame:
    return B.selected(scores(spark, d), "as_of", "score").withColumn("weight", six(F.col("weight")))


@query(f"""WITH {_SELECTED}, px AS (SELECT ticker, last_day(date) AS as_of, arg_max(close, date) AS close FROM bars GROUP BY 1, 2), h AS (SELECT held.*, (date_trunc('month', as_of) - INTERVAL 1 DAY)::DATE AS prev, close FROM held JOIN px USING (ticker, as_of)),
nx AS (SELECT a.as_of, sum(a.weight * (b.close / a.close - 1)) AS gross FROM h a JOIN px b ON a.ticker = b.ticker AND b.as_of = last_day(a.as_of + 1) GROUP BY 1),
tv AS (SELECT as_of, 0.5 * sum(abs(w)) AS turnover FROM (SELECT coalesce(a.as_of, last_day(b.as_of + 1)) AS as_of, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS w FROM held a FULL JOIN held b ON a.ticker = b.ticker AND a.as_of = last_day(b.as_of + 1)) GROUP BY 1)
SELECT as_of, CAST(bps AS INTEGER) AS bps, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * 2 * bps / 10000, 6) AS net FROM nx JOIN tv USING (as_of), (SELECT unnest([0, 10, 20]) AS bps)""")
@V.bars_once
def b05_factor_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Each month's selection, its return to the next month's end, turnover and net under three costs."""
    held = B.selected(scores(spark, d), "as_of", "score").select("as_of", "ticker", "weight")
    px = V.bars(spark, d).groupBy("ticker", F.last_day("date").alias("as_of")).agg(F.max_by("close", "date").alias("close"))
    then = px.select("ticker", F.last_day(F.add_months(F.date_trunc("month", "as_of").cast("date"), -1)).alias("as_of"), F.col("close").alias("then"))
    gross = held.join(px, ["ticker", "as_of"]).join(then, ["ticker", "as_of"]).groupBy("as_of").agg(F.sum(F.col("weight") * (F.col("then") / F.col("close") - 1)).alias("gross"))
    before = held.select("ticker", F.last_day(F.date_add("as_of", 1)).alias("as_of"), F.col("weight").alias("was"))
    moved = held.join(before, ["ticker", "as_of"], "full_outer").groupBy("as_of").agg((0.5 * F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).alias("turnover"))
    out = B.scenarios(gross.join(moved, "as_of"), F.col("gross"), F.col("turnover"), [0, 10, 20])
    return out.select("as_of", "bps", *[six(F.col(c)).alias(c) for c in ("gross", "turnover", "net")])


@query(None)
def b02_greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    """With memory of the month before: three runs, of 10, 20 and 30 names."""
    sizes = F.explode(F.array(*[F.lit(n) for n in (10, 20, 30)])).alias("n")
    return B.greedy(scores(spark, d).select("*", sizes).withColumn("run", F.col("n")), "as_of")


@query(None)
def b07_bootstrap_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return B.bootstrap_sharpe(monthly(spark, d), "ticker", "ret", 12)


@query(None)
def b09_event_engine(spark: SparkSession, d: str) -> DataFrame:
    """B09, P15 and UD5: an account a sector follows the trends of all its names; every trade that volume and cash let pass."""
    bars = V.bars(spark, d).join(V.security(spark, d).select("ticker", F.col("sector").alias("run")), "ticker")
    runs = E.lived(bars.select("run", "date", "ticker", "close", "volume", F.lit(None).cast("double").alias("weight")), E.trending())
    return E.trades(runs).select("run", "date", "ticker", "side", *[six(F.col(c)).alias(c) for c in ("quantity", "price", "fee")])


def _rebalanced(spark: SparkSession, d: str) -> DataFrame:
    """Three accounts that follow the monthly selection every 30 days, each with its own slippage. Volume sets no limit."""
    targets = B.selected(scores(spark, d), "as_of", "score").select("ticker", F.col("as_of").alias("date"), F.lit(None).cast("double").alias("close"), "weight")
    bars = V.bars(spark, d).join(targets.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "date", "close", F.lit(None).cast("double").alias("weight"))
    costs = F.explode(F.array(*[F.lit(bps) for bps in (0, 10, 20)])).alias("slip_bps")
    rows = bars.unionByName(targets).select("*", F.lit(None).cast("double").alias("volume"), costs).withColumn("run", F.col("slip_bps"))
    return E.lived(rows, E.rebalancing(), share=None)


@query(None)
def b10_rebalanced_accounts(spark: SparkSession, d: str) -> DataFrame:
    """The daily value of each account, its cash and holdings, marked at the last close."""
    return _rebalanced(spark, d).select("run", "date", six(F.col("equity")).alias("equity"), six(F.col("cash")).alias("cash"), "n_held", F.size("trades").alias("n_trades"))


@query(None)
def b10_rebalance_trades(spark: SparkSession, d: str) -> DataFrame:
    """Sales before purchases, with the prices paid and fees."""
    return E.trades(_rebalanced(spark, d)).select("run", "date", "ticker", "side", *[six(F.col(c)).alias(c) for c in ("quantity", "price", "fee")])


_TOP = f"""{V.BARS}, top AS (SELECT ticker FROM bars GROUP BY 1 ORDER BY sum(volume) DESC, ticker LIMIT 20), l AS (SELECT ticker, date, ln(close) - lag(ln(close)) OVER ({_W}) AS r FROM bars WHERE ticker IN (SELECT ticker FROM top)),
f AS (SELECT * FROM l WHERE r IS NOT NULL), cov AS (SELECT a.ticker AS t1, b.ticker AS t2, covar_samp(a.r, b.r) AS cov FROM f a JOIN f b ON a.date = b.date GROUP BY 1, 2)"""


def universe(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """ticker, weight of the 20 most traded tickers, and their covariances."""
    bars = V.bars(spark, d)
    top = bars.groupBy("ticker").agg(F.sum("volume").alias("v")).orderBy(F.desc("v"), "ticker").limit(20)
    logs = bars.join(F.broadcast(top.select("ticker")), "ticker", "left_semi").select("ticker", "date", (F.ln("close") - F.lag(F.ln("close")).over(by_ticker())).alias("r")).where("r IS NOT NULL")
    return top.select("ticker", (1 / F.count("*").over(whole())).alias("weight")), R.covariances(logs)


@query(f"""WITH {_TOP}, w AS (SELECT ticker, 1.0 / count(*) OVER () AS weight FROM top), s AS (SELECT t1 AS ticker, sum(cov * weight) AS sw FROM cov JOIN w ON t2 = w.ticker GROUP BY 1), v AS (SELECT sqrt(sum(weight * sw)) AS sigma FROM s JOIN w USING (ticker))
SELECT ticker, round(1.6448536269514722 * sw / sigma, 6) AS marginal, round(weight * 1.6448536269514722 * sw / sigma, 6) AS component, round(weight * sw / sigma / sigma, 6) AS share FROM s JOIN w USING (ticker), v""")
def p09_component_var(spark: SparkSession, d: str) -> DataFrame:
    weights, cov = universe(spark, d)
    return P.component_var(weights, cov).select("ticker", *[six(F.col(c)).alias(c) for c in ("marginal", "component", "share")])


@query(f"""WITH {V.MARKET}, v AS (SELECT ticker, arg_max(close, date) AS spot, stddev_samp(ret) * sqrt(252) AS vol, covar_samp(ret, mkt) / nullif(var_samp(mkt), 0) AS beta FROM rets JOIN market USING (date) WHERE ret IS NOT NULL GROUP BY 1), x AS (SELECT *, (ln(1 / 0.9) + (0.042 + vol * vol / 2) * 0.25) / (vol * 0.5) AS d1 FROM v)
SELECT ticker, round(0.9 * spot * exp(-0.042 * 0.25) * {cdf_sql('vol * 0.5 - d1')} - spot * {cdf_sql('-d1')}, 4) AS put, round((0.9 * spot * exp(-0.042 * 0.25) * {cdf_sql('vol * 0.5 - d1')} - spot * {cdf_sql('-d1')}) / spot * 40000, 2) AS cost_bps,
CASE WHEN beta > 1.2 THEN 1.0 WHEN beta > 0.8 THEN 0.5 ELSE 0.0 END::DOUBLE AS hedge FROM x""")
def p10_tail_hedge(spark: SparkSession, d: str) -> DataFrame:
    """A three-month put 10 % out of the money, and the share to hedge by beta."""
    rets = V.returns(spark, d).where("ret IS NOT NULL")
    beta = F.try_divide(F.covar_samp("ret", "mkt"), F.var_samp("mkt"))
    rows = rets.join(V.market(rets), "date").groupBy("ticker").agg(F.max_by("close", "date").alias("spot"), (F.stddev_samp("ret") * 252**0.5).alias("vol"), beta.alias("beta"))
    put = P.put_price(F.col("spot"), 0.9 * F.col("spot"), F.lit(0.25), 0.042, F.col("vol"))
    return rows.select("ticker", F.round(put, 4).alias("put"), F.round(put / F.col("spot") * 40_000, 2).alias("cost_bps"), P.hedge_ratio(F.col("beta")).alias("hedge"))


_PROFILE = "[" + ", ".join(f"{p / sum(P.PROFILE)!r}" for p in P.PROFILE) + "]::DOUBLE[]"


@query(f"""WITH q AS (SELECT l_suppkey AS ticker, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1), b AS (SELECT ticker, quantity, unnest({_PROFILE}) AS part, CAST(generate_subscripts({_PROFILE}, 1) - 1 AS INTEGER) AS bin FROM q),
r AS (SELECT *, CAST(round(quantity * part) AS BIGINT) AS s FROM b) SELECT ticker, bin, CASE WHEN bin = 12 THEN CAST(quantity AS BIGINT) - CAST(coalesce(sum(s) OVER (PARTITION BY ticker ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) ELSE s END AS shares FROM r""")
def p12_vwap_schedule(spark: SparkSession, d: str) -> DataFrame:
    return P.vwap_schedule(V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ticker")).agg(F.sum("l_quantity").alias("quantity")))


@query(f"""WITH {V.RETS}, v AS (SELECT ticker, stddev_samp(ret) AS sd, avg(volume) AS adv, arg_max(close, date) AS px FROM rets GROUP BY 1)
SELECT ticker, round(sd * sqrt(0.2) * 10000, 4) AS impact_bps, round(px * 1.0005, 6) AS fixed, round(px * (1 + 0.1 * sqrt(0.2)), 6) AS root, round(least(0.1 * adv, 50), 6) AS filled FROM v""")
def p13_impact_and_slippage(spark: SparkSession, d: str) -> DataFrame:
    """An order of a fifth of a day's volume; fills of at most a tenth of it."""
    c = F.col
    rows = V.returns(spark, d).groupBy("ticker").agg(F.stddev_samp("ret").alias("sd"), F.avg("volume").alias("adv"), F.max_by("close", "date").alias("px"))
    fixed, root = P.slipped(c("px"), F.lit(1), 0.2 * c("adv"), c("adv"))
    return rows.select("ticker", F.round(P.impact_bps(c("sd"), 0.2 * c("adv"), c("adv")), 4).alias("impact_bps"), six(fixed).alias("fixed"), six(root).alias("root"), six(F.least(0.1 * c("adv"), F.lit(50))).alias("filled"))


@query(f"""WITH {_SELECTED}, l AS (SELECT * FROM held WHERE as_of = (SELECT max(as_of) FROM held)), m AS (SELECT max(weight) AS w, string_agg(CASE WHEN weight > 0.055 THEN ticker::VARCHAR END, ',' ORDER BY ticker) AS v FROM l),
s AS (SELECT max(w) AS w, coalesce(string_agg(CASE WHEN w > 0.25 THEN sector END, ',' ORDER BY sector), '') AS v FROM (SELECT sector, sum(weight) AS w FROM l GROUP BY 1)),
bt AS (SELECT sum(weight * -bab) AS w FROM l JOIN panel USING (as_of, ticker))
SELECT 'max_weight' AS rule, w <= 0.055 AS passed, round(w, 6) AS worst, coalesce(v, '') AS violators FROM m UNION ALL SELECT 'sector', w <= 0.25, round(w, 6), v FROM s UNION ALL SELECT 'beta', w BETWEEN 0.5 AND 1.5, round(w, 6), '' FROM bt""")
@V.bars_once
def p08_constraint_checks(spark: SparkSession, d: str) -> DataFrame:
    held = B.selected(scores(spark, d), "as_of", "score")
    last = held.join(F.broadcast(held.agg(F.max("as_of").alias("as_of"))), "as_of").join(panel(spark, d).select("as_of", "ticker", (-F.col("bab")).alias("beta")), ["as_of", "ticker"])
    return P.constraint_checks(last, 0.055, 0.25, (0.5, 1.5)).withColumn("worst", six(F.col("worst")))


@query("""WITH h AS (SELECT c_nationkey AS holder, o_orderpriority AS fund, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), w AS (SELECT holder, fund, v / sum(v) OVER (PARTITION BY holder) AS weight FROM h),
p AS (SELECT o_orderpriority AS fund, c_mktsegment AS asset, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT holder, asset, round(sum(weight * share / 100), 6) AS weight FROM w JOIN p USING (fund) GROUP BY 1, 2""")
def p18_look_through(spark: SparkSession, d: str) -> DataFrame:
    """Nations hold priorities as funds, whose parts are market segments in percent."""
    rows = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    held = rows.groupBy(F.col("c_nationkey").alias("holder"), F.col("o_orderpriority").alias("fund")).agg(F.sum("o_totalprice").alias("v"))
    held = held.withColumn("weight", F.col("v") / F.sum("v").over(whole("holder")))
    parts = rows.groupBy(F.col("o_orderpriority").alias("fund"), F.col("c_mktsegment").alias("asset")).agg(F.count("*").alias("n"))
    parts = parts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(whole("fund")))
    return P.look_through(held, parts).withColumn("weight", six(F.col("weight")))


@query(f"""WITH {_SELECTED}, l AS (SELECT * FROM held WHERE as_of = (SELECT max(as_of) FROM held)), px AS (SELECT ticker, arg_max(close, date) AS price FROM bars GROUP BY 1)
SELECT ticker, round(weight, 6) AS weight, round(price, 6) AS price, CAST(floor(weight * 1000000 / price) AS BIGINT) AS shares FROM l JOIN px USING (ticker) WHERE weight > 0.001""")
def p17_trade_list(spark: SparkSession, d: str) -> DataFrame:
    """PF09, J13 and P17."""
    held = B.selected(scores(spark, d), "as_of", "score")
    last = held.join(F.broadcast(held.agg(F.max("as_of").alias("as_of"))), "as_of").where("weight > 0.001")
    px = V.bars(spark, d).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    return last.join(px, "ticker").select("ticker", six(F.col("weight")).alias("weight"), six(F.col("price")).alias("price"), F.floor(F.col("weight") * 1_000_000 / F.col("price")).alias("shares"))
