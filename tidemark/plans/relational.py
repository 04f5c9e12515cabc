"""Scans, filters, joins, aggregates, sorts and set operations over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import six
from tidemark.functions.windows import by_ticker, change, whole
from tidemark.operators import relational as R
from tidemark.plans.registry import query
from tidemark.sources import views as V


@query(f"""WITH {V.BARS} SELECT ticker, date, round(adj_close, 6) AS adj_close, volume FROM bars
WHERE ticker IN (1, 3, 5) AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def sc01_price_range(spark: SparkSession, d: str) -> DataFrame:
    rows = R.price_range(V.bars(spark, d), [1, 3, 5], "1997-01-01", "1998-12-31", ["adj_close", "volume"])
    return rows.withColumn("adj_close", six("adj_close"))


@query(f"""WITH {V.BARS}, {V.SECURITY} SELECT name, date, round(close, 6) AS close FROM bars JOIN security USING (ticker) WHERE sector = 'ASIA'""")
def sc02_prices_by_name(spark: SparkSession, d: str) -> DataFrame:
    dim = V.security(spark, d).where("sector = 'ASIA'").select("ticker", "name")
    return V.bars(spark, d).join(dim, "ticker").select("name", "date", six(F.col("close")).alias("close"))


@query(f"""WITH {V.FUNDAMENTALS} SELECT ticker, period, round(revenue, 4) AS revenue, orders FROM (
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS k FROM fundamentals WHERE period <= DATE '1999-06-30') WHERE k = 1""")
def sc04_fundamentals_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = R.latest(V.fundamentals(spark, d).where(F.col("period") <= F.lit("1999-06-30").cast("date")), ["ticker"], "period")
    return rows.select("ticker", "period", F.round("revenue", 4).alias("revenue"), "orders")


_EAV = f"""WITH {V.FUNDAMENTALS}, eav AS (SELECT ticker, period, 'revenue' AS metric, revenue AS value FROM fundamentals
UNION ALL SELECT ticker, period, 'cost', cost FROM fundamentals UNION ALL SELECT ticker, period, 'tax', tax FROM fundamentals)"""


@query(f"""{_EAV} SELECT ticker, round(arg_max(value, period) FILTER (metric = 'revenue'), 4) AS revenue,
round(arg_max(value, period) FILTER (metric = 'cost'), 4) AS cost, round(arg_max(value, period) FILTER (metric = 'tax'), 4) AS tax FROM eav GROUP BY 1""")
def sc05_eav_to_wide(spark: SparkSession, d: str) -> DataFrame:
    eav = R.narrow(V.fundamentals(spark, d), ["ticker", "period"], ["revenue", "cost", "tax"])
    return R.wide(eav, "ticker", "period", ["revenue", "cost", "tax"]).select("ticker", *[F.round(c, 4).alias(c) for c in ("revenue", "cost", "tax")])


@query(f"""WITH {V.BARS} SELECT DISTINCT ticker FROM bars WHERE date <= DATE '1995-01-10'""")
def sc06_universe_as_of(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").where(F.to_date("l_shipdate") <= F.lit("1995-01-10").cast("date"))
    return li.select(F.col("l_suppkey").alias("ticker")).distinct()


@query(f"""WITH {V.BARS} SELECT ticker, round(arg_max(adj_close, date), 6) AS price, max(date) AS priced_on FROM bars WHERE date <= DATE '1998-03-15' GROUP BY 1""")
def sc07_price_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = V.bars(spark, d).where(F.col("date") <= F.lit("1998-03-15").cast("date"))
    return rows.groupBy("ticker").agg(six(F.max_by("adj_close", "date")).alias("price"), F.max("date").alias("priced_on"))


@query(f"""WITH {V.BARS} SELECT count(*) AS bars, min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS tickers FROM bars""")
def sc21_lake_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.bars(spark, d).agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("ticker").alias("tickers"))


@query(f"""WITH {V.BARS} SELECT ticker, max(date) AS last_date, count(*) AS bars FROM bars GROUP BY 1""")
def sc22_last_date_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    return V.bars(spark, d).groupBy("ticker").agg(F.max("date").alias("last_date"), F.count("*").alias("bars"))


@query("""SELECT l_suppkey AS ticker, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS units FROM lineitem
WHERE year(l_shipdate) = 1997 GROUP BY 1, 2""")
def sc17_scan_by_year(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").where((F.col("l_shipdate") >= "1997-01-01") & (F.col("l_shipdate") < "1998-01-01"))
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("units"))


@query("""SELECT replace(replace(upper(p_name), '.', '-'), ' ', '-') AS symbol, p_brand FROM part WHERE p_retailprice IS NOT NULL""")
def sc19_symbol_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").where("p_retailprice IS NOT NULL").select(F.regexp_replace(F.upper("p_name"), "[. ]", "-").alias("symbol"), "p_brand")


@query(f"""WITH {V.BARS} SELECT ticker, date, round(close, 6) AS close FROM bars
WHERE date <= DATE '1998-06-30' - INTERVAL 1 DAY AND date > DATE '1998-06-30' - INTERVAL 31 DAY""")
def pf03_visible_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = R.visible(V.bars(spark, d), "date", "1998-06-30", R.LAGS["price"]).where(F.col("date") > F.lit("1998-05-30").cast("date"))
    return rows.select("ticker", "date", six(F.col("close")).alias("close"))


@query(f"""WITH {V.FUNDAMENTALS} SELECT ticker, period, period + 45 AS known_on, period - 45 AS effective_by, (period + 45) <= DATE '1998-06-30' AS visible FROM fundamentals""")
def pf04_knowledge_dates(spark: SparkSession, d: str) -> DataFrame:
    lag = R.LAGS["fundamental"]
    return V.fundamentals(spark, d).select(
        "ticker", "period", F.date_add("period", lag).alias("known_on"), F.date_sub("period", lag).alias("effective_by"),
        (F.date_add("period", lag) <= F.lit("1998-06-30").cast("date")).alias("visible"),
    )


@query(f"""WITH {V.SECURITY}, names AS (SELECT * FROM (VALUES ('asia'), ('MIDDLE'), ('Europe and more'), ('AMER')) t(wanted))
SELECT DISTINCT wanted, sector FROM names, security WHERE contains(lower(sector), lower(wanted)) OR contains(lower(wanted), lower(sector))""")
def pf07_sector_name_match(spark: SparkSession, d: str) -> DataFrame:
    sectors = V.security(spark, d).select("sector").distinct()
    wanted = F.explode(F.array(*[F.lit(x) for x in ("asia", "MIDDLE", "Europe and more", "AMER")])).alias("wanted")
    both = F.lower("sector").contains(F.lower("wanted")) | F.lower("wanted").contains(F.lower("sector"))
    return sectors.select("sector", wanted).where(both).select("wanted", "sector")


@query(f"""WITH {V.BARS}, {V.SECURITY} SELECT industry, count(*) AS n, round(avg(close), 6) AS mean_close FROM bars JOIN security USING (ticker) GROUP BY 1""")
def j01_bars_by_industry(spark: SparkSession, d: str) -> DataFrame:
    sums = V.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("k"), F.sum("close").alias("s"))  # before the join: a row a ticker
    return sums.join(V.security(spark, d), "ticker").groupBy("industry").agg(F.sum("k").alias("n"), six(F.sum("s") / F.sum("k")).alias("mean_close"))


@query(f"""WITH {V.SECURITY}, {V.EDGES}, score AS (SELECT supplier AS ticker, sum(weight) AS ml FROM edges GROUP BY 1)
SELECT ticker, round(0.4 * coalesce(ml, 0) + 0.6 * equity, 6) AS blended FROM security LEFT JOIN score USING (ticker)""")
def j02_left_join_scores(spark: SparkSession, d: str) -> DataFrame:
    score = V.edges(spark, d).groupBy(F.col("supplier").alias("ticker")).agg(F.sum("weight").alias("ml"))
    return V.security(spark, d).join(score, "ticker", "left").select("ticker", six(0.4 * F.coalesce("ml", F.lit(0.0)) + 0.6 * F.col("equity")).alias("blended"))


@query(f"""WITH {V.MARKET} SELECT a.ticker, count(*) AS days, round(corr(a.ret, m.mkt), 6) AS corr FROM rets a JOIN market m USING (date) WHERE a.ret IS NOT NULL GROUP BY 1""")
def j03_aligned_returns(spark: SparkSession, d: str) -> DataFrame:
    rets = V.returns(spark, d).where("ret IS NOT NULL")
    both = rets.withColumn("mkt", F.avg("ret").over(whole("date")))
    return both.groupBy("ticker").agg(F.count("*").alias("days"), six(F.corr("ret", "mkt")).alias("corr"))


@query(f"""WITH {V.BARS}, {V.FUNDAMENTALS} SELECT f.ticker, f.period, b.date AS priced_on, round(b.close, 6) AS close
FROM fundamentals f ASOF LEFT JOIN bars b ON f.ticker = b.ticker AND f.period >= b.date""")
def j04_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    left = V.fundamentals(spark, d).select("ticker", F.col("period").alias("date"))
    out = R.as_of(left, V.bars(spark, d).select("ticker", "date", "close"), ["ticker"], "date", ["close"], seen="priced_on")
    return out.select("ticker", F.col("date").alias("period"), "priced_on", six(F.col("close")).alias("close"))


@query(f"""WITH {V.BARS}, {V.FUNDAMENTALS} SELECT ticker, period, date AS priced_on, round(close, 6) AS close FROM (
SELECT f.ticker, f.period, b.date, b.close, row_number() OVER (PARTITION BY f.ticker, f.period ORDER BY abs(b.date - f.period), b.date) AS k
FROM fundamentals f JOIN bars b ON f.ticker = b.ticker AND b.date BETWEEN f.period - 7 AND f.period + 7) WHERE k = 1""")
def j05_nearest_join(spark: SparkSession, d: str) -> DataFrame:
    left = V.fundamentals(spark, d).select("ticker", F.col("period").alias("date"))
    out = R.nearest(left, V.bars(spark, d).select("ticker", "date", "close"), ["ticker"], "date", ["close"], 7, seen="priced_on")
    return out.select("ticker", F.col("date").alias("period"), "priced_on", six(F.col("close")).alias("close"))


@query(f"""WITH {V.BARS}, days AS (SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'),
tickers AS (SELECT DISTINCT ticker FROM bars) SELECT ticker, date FROM tickers, days EXCEPT SELECT ticker, date FROM bars""")
def j06_missing_days(spark: SparkSession, d: str) -> DataFrame:
    rows = V.bars(spark, d).select("ticker", "date")
    days = rows.where(F.col("date").between("1997-01-01", "1997-03-31")).select("date").distinct()
    return R.missing_days(rows, days)


@query(f"""WITH {V.BARS} SELECT ticker, date FROM bars WHERE ticker IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def j07_known_tickers(spark: SparkSession, d: str) -> DataFrame:
    rich = V.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("ticker"))
    return V.bars(spark, d).select("ticker", "date").join(rich, "ticker", "left_semi")


_WEIGHTS = f"""WITH {V.BARS}, w AS (SELECT ticker, CAST(year(date) AS INTEGER) AS y, sum(volume) AS v FROM bars GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, ticker) AS k FROM w),
held AS (SELECT ticker, y, v / sum(v) OVER (PARTITION BY y) AS weight FROM ranked WHERE k <= 20)"""


@query(f"""{_WEIGHTS} SELECT y, round(0.5 * sum(abs(d)), 6) AS turnover FROM (
SELECT coalesce(a.y, b.y + 1) AS y, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM held a FULL JOIN held b ON a.ticker = b.ticker AND a.y = b.y + 1) WHERE y BETWEEN 1996 AND 2001 GROUP BY 1""")
def j08_turnover(spark: SparkSession, d: str) -> DataFrame:
    held = _held(spark, d)
    return R.turnover(held, "y").where("y BETWEEN 1996 AND 2001").select("y", six(F.col("turnover")).alias("turnover"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    by_year = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("v"))
    top = R.top_k(by_year, ["y"], [F.desc("v"), F.asc("ticker")], 20)
    return top.select("ticker", "y", (F.col("v") / F.sum("v").over(whole("y"))).alias("weight"))


@query(f"""WITH {V.EDGES}, sides AS (SELECT supplier AS ticker, customer AS other, weight FROM edges UNION ALL SELECT customer, supplier, weight FROM edges)
SELECT b.ticker, round(sum(b.weight * s.s_acctbal) / sum(b.weight), 6) AS neighbours FROM sides b JOIN supplier s ON b.other = s.s_suppkey GROUP BY 1""")
def j10_graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    both = R.both_ways(V.edges(spark, d))
    signal = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("other"), "s_acctbal")
    return both.join(signal, "other").groupBy("ticker").agg(six(F.sum(F.col("weight") * F.col("s_acctbal")) / F.sum("weight")).alias("neighbours"))


@query(f"""WITH {V.SECURITY}, few AS (SELECT ticker, sector FROM security WHERE ticker % 3 <> 0) SELECT s.ticker, coalesce(few.sector, 'Other') AS sector FROM security s LEFT JOIN few USING (ticker)""")
def j12_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    dim = V.security(spark, d)
    few = dim.where("ticker % 3 <> 0").select("ticker", F.col("sector").alias("found"))
    return dim.select("ticker").join(few, "ticker", "left").select("ticker", F.coalesce("found", F.lit("Other")).alias("sector"))


@query(f"""WITH {V.FUNDAMENTALS} SELECT ticker, period, round(revenue - lag(revenue) OVER w, 4) AS d_revenue, round(cost - lag(cost) OVER w, 4) AS d_cost
FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY period)""")
def j14_period_changes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("period")
    return V.fundamentals(spark, d).select("ticker", "period", *[F.round(F.col(c) - F.lag(c).over(w), 4).alias(f"d_{c}") for c in ("revenue", "cost")])


@query(f"""WITH {V.RETS} SELECT ticker, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(stddev_pop(ret), 6) AS sd_pop, round(median(ret), 6) AS median,
round(quantile_cont(ret, 0.05), 6) AS p05, round(quantile_cont(ret, 0.95), 6) AS p95, count(ret) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total FROM rets GROUP BY 1""")
def ag05_return_moments(spark: SparkSession, d: str) -> DataFrame:
    return V.returns(spark, d).groupBy("ticker").agg(
        six(F.avg("ret")).alias("mean"), six(F.stddev_samp("ret")).alias("sd"), six(F.stddev_pop("ret")).alias("sd_pop"), six(F.median("ret")).alias("median"),
        six(F.percentile("ret", F.lit(0.05))).alias("p05"), six(F.percentile("ret", F.lit(0.95))).alias("p95"), F.count("ret").alias("n"),
        six(F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("total"),
    )


@query(f"""WITH {V.RETS}, m AS (SELECT ticker, ret, avg(ret) OVER (PARTITION BY ticker) AS mu FROM rets WHERE ret IS NOT NULL)
SELECT ticker, round(avg(pow(ret-mu,3)) / pow(avg(pow(ret-mu,2)),1.5), 4) AS skewness, round(avg(pow(ret-mu,4)) / pow(avg(pow(ret-mu,2)),2), 4) AS kurtosis FROM m GROUP BY 1""")
def ag10_skew_kurtosis(spark: SparkSession, d: str) -> DataFrame:
    return V.returns(spark, d).groupBy("ticker").agg(F.round(F.skewness("ret"), 4).alias("skewness"), F.round(F.kurtosis("ret") + 3, 4).alias("kurtosis"))


@query(f"""WITH {V.BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars)
SELECT ticker, round(max(CASE WHEN k=1 THEN close END),6) AS last, round(max(CASE WHEN k=5 THEN close END),6) AS fifth, round(max(CASE WHEN k=21 THEN close END),6) AS twentyfirst FROM k GROUP BY 1""")
def ag03_nth_from_last(spark: SparkSession, d: str) -> DataFrame:
    return R.nth_from_last(V.bars(spark, d), "close", {"last": 1, "fifth": 5, "twentyfirst": 21}).select("ticker", *[six(F.col(c)).alias(c) for c in ("last", "fifth", "twentyfirst")])


@query(f"""WITH {V.SECURITY} SELECT ticker, sector, round(equity - avg(equity) OVER (PARTITION BY sector), 6) AS above_sector FROM security""")
def ag04_group_mean(spark: SparkSession, d: str) -> DataFrame:
    return V.security(spark, d).select("ticker", "sector", six(F.col("equity") - F.avg("equity").over(whole("sector"))).alias("above_sector"))


@query(f"""WITH {V.BARS}, top AS (SELECT ticker FROM bars GROUP BY 1 ORDER BY sum(volume) DESC, ticker LIMIT 20), r AS (
SELECT ticker, date, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS r FROM bars WHERE ticker IN (SELECT ticker FROM top)),
f AS (SELECT * FROM r WHERE r IS NOT NULL)
SELECT a.ticker AS t1, b.ticker AS t2, count(*) AS days, round(covar_samp(a.r, b.r), 8) AS cov, round(corr(a.r, b.r), 6) AS corr FROM f a JOIN f b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2""")
def m02_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Of the 20 tickers most traded: an optimiser's universe."""
    bars = V.bars(spark, d)
    top = bars.groupBy("ticker").agg(F.sum("volume").alias("v")).orderBy(F.desc("v"), "ticker").limit(20).select("ticker")
    logs = bars.join(F.broadcast(top), "ticker", "left_semi").select("ticker", "date", (F.ln("close") - F.lag(F.ln("close")).over(by_ticker())).alias("r")).where("r IS NOT NULL")
    return R.covariances(logs).select("t1", "t2", "days", F.round("cov", 8).alias("cov"), six(F.col("corr")).alias("corr"))


@query(f"""{_WEIGHTS}, s AS (SELECT y, r_name AS sector, sum(weight) AS weight FROM held JOIN supplier ON ticker = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT y, round(max(weight), 6) AS largest, arg_max(sector, (weight, sector)) AS sector FROM s GROUP BY 1""")
def ag13_sector_concentration(spark: SparkSession, d: str) -> DataFrame:
    sums = _held(spark, d).join(V.security(spark, d).select("ticker", "sector"), "ticker").groupBy("y", "sector").agg(F.sum("weight").alias("weight"))
    return sums.groupBy("y").agg(six(F.max("weight")).alias("largest"), F.max_by("sector", F.struct("weight", "sector")).alias("sector"))


@query(f"""WITH {V.FUNDAMENTALS} SELECT CAST(year(period) AS INTEGER) AS year, count(DISTINCT ticker) AS tickers, round(sum(revenue), 2) AS revenue, round(avg(revenue), 4) AS mean FROM fundamentals GROUP BY 1""")
def ag15_by_year(spark: SparkSession, d: str) -> DataFrame:
    return V.fundamentals(spark, d).groupBy(F.year("period").alias("year")).agg(F.count_distinct("ticker").alias("tickers"), F.round(F.sum("revenue"), 2).alias("revenue"), F.round(F.avg("revenue"), 4).alias("mean"))


@query(f"""WITH {V.RETS} SELECT CAST(least(10, greatest(1, floor((ret + 0.1) / 0.02) + 1)) AS BIGINT) AS bin, count(*) AS n FROM rets WHERE ret IS NOT NULL GROUP BY 1""")
def ag16_return_histogram(spark: SparkSession, d: str) -> DataFrame:
    bin_ = F.least(F.lit(10), F.greatest(F.lit(1), F.floor((F.col("ret") + 0.1) / 0.02) + 1)).cast("long")
    return V.returns(spark, d).where("ret IS NOT NULL").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.RETS} SELECT date, count(*) FILTER (ret > 0) AS inflow, count(*) FILTER (ret < 0) AS outflow, count(*) FILTER (ret IS NULL) AS fresh FROM rets GROUP BY 1""")
def ag17_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.returns(spark, d).groupBy("date").agg(F.count_if(F.col("ret") > 0).alias("inflow"), F.count_if(F.col("ret") < 0).alias("outflow"), F.count_if(F.col("ret").isNull()).alias("fresh"))


@query(f"""WITH {V.BARS}, p AS (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS week, arg_max(close, date) AS close FROM bars GROUP BY 1, 2)
SELECT ticker, week, round(close, 6) AS close, round(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY week), 0) - 1, 6) AS ret FROM p""")
def ag19_weekly_returns(spark: SparkSession, d: str) -> DataFrame:
    p = R.resampled(V.bars(spark, d), "week")
    return p.select("ticker", F.col("date").alias("week"), six(F.col("close")).alias("close"), six(change(F.col("close"))).alias("ret"))


@query(f"""WITH {V.BARS}, p AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2)
SELECT ticker, month, round(close, 6) AS close, round(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY month), 0) - 1, 6) AS ret FROM p""")
def ag19_monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    p = R.resampled(V.bars(spark, d), "month")
    return p.select("ticker", F.col("date").alias("month"), six(F.col("close")).alias("close"), six(change(F.col("close"))).alias("ret"))


@query(f"""WITH {V.SECURITY} SELECT sector, industry, count(*) AS n, round(sum(equity), 4) AS equity, CAST(grouping(sector) AS INTEGER) AS all_sectors, CAST(grouping(industry) AS INTEGER) AS all_industries FROM security GROUP BY ROLLUP (sector, industry)""")
def ag_rollup(spark: SparkSession, d: str) -> DataFrame:
    return V.security(spark, d).rollup("sector", "industry").agg(
        F.count("*").alias("n"), F.round(F.sum("equity"), 4).alias("equity"), F.grouping("sector").cast("int").alias("all_sectors"), F.grouping("industry").cast("int").alias("all_industries")
    )


@query(f"""WITH {V.RETS} SELECT CAST(year(date) AS INTEGER) AS year, ticker % 5 AS book, count(*) AS n, round(avg(ret), 6) AS mean FROM rets GROUP BY CUBE (1, 2)""")
def ag_cube(spark: SparkSession, d: str) -> DataFrame:
    return V.returns(spark, d).cube(F.year("date").alias("year"), (F.col("ticker") % 5).alias("book")).agg(F.count("*").alias("n"), six(F.avg("ret")).alias("mean"))


@query(f"""WITH {V.RETS}, k AS (SELECT date, ticker, ret, row_number() OVER (PARTITION BY date ORDER BY ret DESC, ticker) AS k FROM rets WHERE ret IS NOT NULL) SELECT date, ticker, round(ret, 6) AS ret, CAST(k AS INTEGER) AS k FROM k WHERE k <= 3""")
def t02_top_k_by_date(spark: SparkSession, d: str) -> DataFrame:
    rows = V.returns(spark, d).where("ret IS NOT NULL").select("date", "ticker", "ret")
    return R.top_k(rows, ["date"], [F.desc("ret"), F.asc("ticker")], 3, rank="k").select("date", "ticker", six(F.col("ret")).alias("ret"), "k")


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20""")
def t01_order_limit(spark: SparkSession, d: str) -> DataFrame:
    top = V.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    return top.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""SELECT ticker, kind FROM (SELECT l_suppkey AS ticker, 'early' AS kind FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'
UNION SELECT l_suppkey, 'late' FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-10-01')""")
def u02_union_universes(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), "l_shipdate")
    early = li.where("l_shipdate < '1995-02-01'").select("ticker", F.lit("early").alias("kind"))
    return early.unionByName(li.where("l_shipdate > '2001-10-01'").select("ticker", F.lit("late").alias("kind"))).distinct()


@query("""SELECT l_suppkey AS ticker FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-10-15'""")
def u03_except(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), "l_shipdate")
    return li.where("l_shipdate < '1995-02-01'").select("ticker").subtract(li.where("l_shipdate > '2001-10-15'").select("ticker"))


@query(f"""WITH {V.BARS} SELECT a.date FROM bars a WHERE ticker = 1 INTERSECT SELECT date FROM bars WHERE ticker = 2""")
def u04_common_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = V.bars(spark, d).select("ticker", "date")
    return rows.where("ticker = 1").select("date").intersect(rows.where("ticker = 2").select("date"))


@query("""SELECT ticker, date, seq, round(price, 6) AS price FROM (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey AS seq, p_retailprice AS price,
row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE k = 1""")
def u05_keep_last_duplicate(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").join(V.table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("seq"), "l_linenumber", "l_partkey", F.col("p_retailprice").alias("price"))
    return R.keep_last(rows, ["ticker", "date"], ["seq", "l_linenumber", "l_partkey"]).select("ticker", "date", "seq", six(F.col("price")).alias("price"))


@query(f"""WITH {V.BARS} SELECT ticker, arg_max(open, date) FILTER (WHERE day(date) % 3 <> 0) AS open, arg_max(close, date) FILTER (WHERE day(date) % 5 <> 0) AS close, arg_max(volume, date) FILTER (WHERE volume > 40) AS volume FROM bars GROUP BY 1""")
def ag02_last_known(spark: SparkSession, d: str) -> DataFrame:
    """AG02: of columns with holes in different rows the last value of each."""
    bars = V.bars(spark, d).select(
        "ticker", "date", F.when(F.day("date") % 3 != 0, F.col("open")).alias("open"), F.when(F.day("date") % 5 != 0, F.col("close")).alias("close"), F.when(F.col("volume") > 40, F.col("volume")).alias("volume")
    )
    return R.last_known(bars, "ticker", "date", ["open", "close", "volume"])


@query(f"""WITH {V.FUNDAMENTALS}, u AS (SELECT ticker, period + 45 AS as_of, period + CASE WHEN ticker % 2 = 0 THEN 90 ELSE 30 END AS target FROM fundamentals) SELECT ticker, count(*) AS n, count(*) FILTER (WHERE as_of > target) AS leaking, count(*) FILTER (WHERE as_of <= target) AS kept FROM u GROUP BY 1""")
def pf05_leakage_guard(spark: SparkSession, d: str) -> DataFrame:
    """PF05 and V18: figures used before they are known are counted; what is kept passes the assertion."""
    target = F.date_add("period", F.when(F.col("ticker") % 2 == 0, 90).otherwise(30))
    rows = V.fundamentals(spark, d).select("ticker", F.date_add("period", R.LAGS["fundamental"]).alias("as_of"), target.alias("target"))
    kept = R.asserted(rows.where(~R.leaks("as_of", "target")), "as_of", "target").groupBy("ticker").agg(F.count("*").alias("kept"))
    counts = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(R.leaks("as_of", "target")).alias("leaking"))
    return counts.join(kept, "ticker", "left").na.fill(0, ["kept"])


@query(f"""WITH {V.BARS}, {V.FUNDAMENTALS}, b AS (SELECT ticker, min(date) AS bars_from FROM bars GROUP BY 1), f AS (SELECT ticker, min(period) AS facts_from FROM fundamentals GROUP BY 1)
SELECT ticker, DATE '1993-06-01' - 297 AS facts_needed, DATE '1993-06-01' - 252 AS prices_needed, bars_from <= DATE '1993-06-01' - 252 AND facts_from <= DATE '1993-06-01' - 297 AS feasible FROM b JOIN f USING (ticker)""")
def pf06_feasible_start(spark: SparkSession, d: str) -> DataFrame:
    """PF06: whether a ticker's data reach back far enough for a backtest from a day on."""
    facts, prices = R.needed_from(F.lit("1993-06-01").cast("date"))
    bars = V.bars(spark, d).groupBy("ticker").agg(F.min("date").alias("bars_from"))
    rows = bars.join(V.fundamentals(spark, d).groupBy("ticker").agg(F.min("period").alias("facts_from")), "ticker")
    return rows.select("ticker", facts.alias("facts_needed"), prices.alias("prices_needed"), ((F.col("bars_from") <= prices) & (F.col("facts_from") <= facts)).alias("feasible"))


@query("""SELECT s_suppkey AS ticker, s_name AS name FROM supplier WHERE CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal <= 5000 END IS NOT FALSE""")
def pf11_active(spark: SparkSession, d: str) -> DataFrame:
    flagged = V.table(spark, d, "supplier").withColumn("active", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") <= 5000))
    return flagged.where(R.active("active")).select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS epoch, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts)::TIMESTAMP AS back FROM events""")
def s12_epoch_and_iso(spark: SparkSession, d: str) -> DataFrame:
    """Instants as seconds and as ISO-8601 with Z, and read back from that."""
    rows = V.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select("event_id", F.unix_timestamp("ts").alias("epoch"), iso.alias("iso"), F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ssX").cast("timestamp_ntz").alias("back"))


@query(f"""WITH {V.SECURITY}, g AS (SELECT sector, industry, avg(equity) AS e FROM security GROUP BY 1, 2) SELECT sector, round(sum(CASE WHEN e > 4000 THEN e - 4000 ELSE 0 END), 4) AS positive, count(*) AS n FROM g GROUP BY 1""")
def s16_positive_weights(spark: SparkSession, d: str) -> DataFrame:
    """A sector's industries as a map of weights, of which the positive ones are summed. A sector has a bounded number of industries."""
    means = V.security(spark, d).groupBy("sector", "industry").agg((F.avg("equity") - 4000).alias("e"))
    maps = means.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("industry", "e"))).alias("weights"))
    return maps.select("sector", F.round(R.positive_sum("weights"), 4).alias("positive"), F.size("weights").cast("long").alias("n"))


@query(f"""WITH {V.BARS}, {V.FUNDAMENTALS}, t AS (SELECT ticker, max(date) AS date FROM bars GROUP BY 1),
p AS (SELECT t.ticker, (SELECT arg_max(close, b.date) FROM bars b WHERE b.ticker = t.ticker AND b.date <= t.date - 30) AS m1, (SELECT arg_max(close, b.date) FROM bars b WHERE b.ticker = t.ticker AND b.date <= t.date - 365) AS m12,
(SELECT arg_max(close, b.date) FROM bars b WHERE b.ticker = t.ticker AND b.date <= t.date) AS now_, (SELECT arg_max(struct_pack(e := f.revenue - f.cost, b := f.units), f.period) FROM fundamentals f WHERE f.ticker = t.ticker AND f.period <= t.date) AS f FROM t)
SELECT ticker, round(m1 / nullif(m12, 0) - 1, 6) AS momentum, round(now_ / nullif(f.e / 1000, 0), 6) AS pe, round(now_ / nullif(f.b, 0), 6) AS pb FROM p""")
def f44_calendar_factors(spark: SparkSession, d: str) -> DataFrame:
    """the price 30 days back over that 365 days back, and the last price over the last earnings and book figures, all by as-of joins."""
    bars, facts = V.bars(spark, d).select("ticker", "date", "close"), V.fundamentals(spark, d)
    last = bars.groupBy("ticker").agg(F.max("date").alias("end"))
    asked = last.select("ticker", F.explode(F.array(*[F.struct(F.lit(n).alias("back"), F.date_sub("end", n).alias("date")) for n in (0, 30, 365)])).alias("a")).select("ticker", "a.*")
    prices = R.as_of(asked, bars, ["ticker"], "date", ["close"], "seen").groupBy("ticker").agg(*[F.max(F.when(F.col("back") == n, F.col("close"))).alias(c) for n, c in ((0, "now"), (30, "m1"), (365, "m12"))])
    known = R.as_of(last.withColumnRenamed("end", "period"), facts.select("ticker", "period", (F.col("revenue") - F.col("cost")).alias("e"), F.col("units").alias("b")), ["ticker"], "period", ["e", "b"], "seen")
    rows = prices.join(known, "ticker", "left")
    return rows.select("ticker", six(F.try_divide(F.col("m1"), F.col("m12")) - 1).alias("momentum"), six(F.try_divide(F.col("now"), F.col("e") / 1000)).alias("pe"), six(F.try_divide(F.col("now").cast("double"), F.col("b").cast("double"))).alias("pb"))


@query("""WITH r AS (SELECT * FROM (VALUES ('EUROPE', 1.1), ('ASIA', 0.01), ('AFRICA', 0.05)) t(currency, per_unit)), a AS (SELECT s_suppkey AS ticker, r_name AS currency, s_acctbal AS amount FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT ticker, currency, round(CASE WHEN currency = 'AMERICA' THEN amount ELSE amount * per_unit END, 4)::DOUBLE AS amount FROM a LEFT JOIN r USING (currency)""")
def h25_converted(spark: SparkSession, d: str) -> DataFrame:
    """Balances of each region's currency in that of one."""
    rates = spark.createDataFrame([("EUROPE", 1.1), ("ASIA", 0.01), ("AFRICA", 0.05)], "currency string, per_unit double")
    rows = V.security(spark, d).select("ticker", F.col("sector").alias("currency"), F.col("equity").cast("double").alias("amount"))
    return R.converted(rows, rates, "amount", "AMERICA").withColumn("amount", F.round("amount", 4))


@query(f"""WITH {V.FUNDAMENTALS} SELECT ticker, min(period + 45) FILTER (WHERE period + 45 >= DATE '1997-05-20') AS next_report, CAST(min(period + 45) FILTER (WHERE period + 45 >= DATE '1997-05-20') - DATE '1997-05-20' AS INTEGER) AS days_until, CAST(DATE '1997-05-20' - max(period + 45) FILTER (WHERE period + 45 < DATE '1997-05-20') AS INTEGER) AS days_since FROM fundamentals GROUP BY 1""")
def h34_days_until_report(spark: SparkSession, d: str) -> DataFrame:
    """Days to a ticker's next report and since its last one."""
    day, report = F.lit("1997-05-20").cast("date"), F.date_add("period", R.LAGS["fundamental"])
    rows = V.fundamentals(spark, d).groupBy("ticker").agg(F.min(F.when(report >= day, report)).alias("next_report"), F.max(F.when(report < day, report)).alias("last"))
    return rows.select("ticker", "next_report", F.datediff("next_report", day).alias("days_until"), F.datediff(day, "last").alias("days_since"))


@query(f"""WITH {V.BARS} SELECT ticker, date, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '1997-06-30' - 180 AND DATE '1997-06-30' + 180""")
def sc08_window_around(spark: SparkSession, d: str) -> DataFrame:
    """SC08: all prices within 180 days of a day, as one bounded read."""
    day = F.lit("1997-06-30").cast("date")
    return V.bars(spark, d).where(F.col("date").between(F.date_sub(day, 180), F.date_add(day, 180))).select("ticker", "date", six(F.col("close")).alias("close"))


@query(f"""WITH {V.BARS}, w AS (SELECT unnest([7, 3, 999999, 1]) AS ticker, unnest([0, 1, 2, 3])::INTEGER AS place), l AS (SELECT ticker, arg_max(close, date) AS close FROM bars GROUP BY 1) SELECT w.ticker::BIGINT AS ticker, place, coalesce(round(close, 6), 0)::DOUBLE AS close FROM w LEFT JOIN l USING (ticker)""")
def j11_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """Last prices in the order of a list of tickers, 0 for one that has none."""
    wanted = spark.createDataFrame([(7, 0), (3, 1), (999999, 2), (1, 3)], "ticker long, place int")
    last = R.latest(V.bars(spark, d).select("ticker", "date", "close"), ["ticker"], "date")
    return wanted.join(last, "ticker", "left").select("ticker", "place", F.coalesce(six(F.col("close")), F.lit(0.0)).alias("close"))
