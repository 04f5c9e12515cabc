"""Fundamental factors, sentiment and valuation models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio, six
from tidemark.operators import relational as R
from tidemark.operators import valuation as N
from tidemark.plans.registry import query, sixes
from tidemark.sources import views as V

_CO = f"""{V.FUNDAMENTALS}, c1 AS (SELECT *, sum(revenue) OVER y AS ttm, sum(cost) OVER y AS ttm_cost, count(*) OVER y AS quarters, lag(revenue, 4) OVER w AS revenue_before
FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY period), y AS (PARTITION BY ticker ORDER BY period ROWS 3 PRECEDING)),
c2 AS (SELECT *, revenue / nullif(revenue_before, 0) - 1 AS yoy FROM c1),
co AS (SELECT *, yoy - lag(yoy) OVER w AS surprise, lag(ttm, 4) OVER w AS ttm_before, lag(cost, 4) OVER w AS cost_before FROM c2 WINDOW w AS (PARTITION BY ticker ORDER BY period)),
companies AS (SELECT * FROM co WHERE quarters = 4)"""
#: One row a company: the last full quarter with per-share figures (a share for each 1000 of trailing units is notional).
_ONE = f"""{_CO}, {V.SECURITY}, one AS (SELECT c.ticker, sector, equity, ttm, ttm_cost, ttm - ttm_cost AS profit, ttm / nullif(ttm_before, 0) - 1 AS g, (ttm - ttm_cost) / 1000 AS flow,
(ttm - ttm_cost) / 1000 * 12 AS price, abs(equity) + 1000 AS book, least(0.3, ttm_cost / nullif(ttm, 0)) AS lev FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS k FROM companies) c JOIN security s USING (ticker) WHERE k = 2)"""


def one(spark: SparkSession, d: str) -> DataFrame:
    """ticker, sector, equity, ttm, ttm_cost, profit, g, flow, price, book, lev: each company at its last but one quarter."""
    w = Window.partitionBy("ticker").orderBy(F.desc("period"))
    rows = N.companies(V.fundamentals(spark, d)).withColumn("k", F.row_number().over(w)).where("k = 2").join(V.security(spark, d), "ticker")
    flow = (F.col("ttm") - F.col("ttm_cost")) / 1000
    return rows.select(
        "ticker", "sector", "equity", "ttm", "ttm_cost", (F.col("ttm") - F.col("ttm_cost")).alias("profit"), (ratio(F.col("ttm"), F.col("ttm_before")) - 1).alias("g"), flow.alias("flow"),
        (flow * 12).alias("price"), (F.abs("equity") + 1000).alias("book"), F.least(F.lit(0.3), ratio(F.col("ttm_cost"), F.col("ttm"))).alias("lev"),
    )


def _i(x: str, lo: float, hi: float) -> str:
    return f"(greatest(0, least(1, (({x}) - {lo}) / ({hi} - {lo}))) * 100)"


@query(f"""WITH {_ONE} SELECT ticker, round(0.4*{_i('flow/book', 0, 0.3)} + 0.3*{_i('profit/ttm', 0, 0.6)} + 0.3*(100-{_i('lev', 0, 2)}), 6) AS quality,
round(0.6*(100-{_i('CASE WHEN price/nullif(flow,0) <= 0 THEN 50 ELSE price/nullif(flow,0) END', 10, 50)}) + 0.4*(100-{_i('CASE WHEN price/book <= 0 THEN 10 ELSE price/book END', 1, 10)}), 6) AS value,
round(0.5*{_i('g', 0, 0.3)} + 0.5*{_i('g*1.2', 0, 0.3)}, 6) AS growth FROM one""")
def f14_fundamental_scores(spark: SparkSession, d: str) -> DataFrame:
    """F12, F14-F17 and F46."""
    c = F.col
    return one(spark, d).select(
        "ticker", six(N.quality(ratio(c("flow"), c("book")), ratio(c("profit"), c("ttm")), c("lev"))).alias("quality"),
        six(N.value(ratio(c("price"), c("flow")), ratio(c("price"), c("book")))).alias("value"), six(N.growth(c("g"), c("g") * 1.2)).alias("growth"),
    )


@query(f"""WITH {_ONE}, z AS (SELECT ticker, (flow/book - avg(flow/book) OVER ()) / nullif(stddev_samp(flow/book) OVER (), 0) AS zr, (profit/ttm - avg(profit/ttm) OVER ()) / nullif(stddev_samp(profit/ttm) OVER (), 0) AS zm, 1/(1+lev) AS safety, g FROM one)
SELECT ticker, round((coalesce(zr,0)+coalesce(zm,0)) / nullif((zr IS NOT NULL)::INT + (zm IS NOT NULL)::INT, 0), 6) AS quality_z, round(0.5*coalesce(zr,0) + 0.2*g + 0.3*safety, 6) AS qmj FROM z""")
def f18_quality_minus_junk(spark: SparkSession, d: str) -> DataFrame:
    """F13 and F18. The cross-section is a row a company; its mean and spread are aggregated and joined, not windowed in one task."""
    c = F.col
    rows = one(spark, d).select("ticker", ratio(c("flow"), c("book")).alias("r"), ratio(c("profit"), c("ttm")).alias("m"), (1 / (1 + c("lev"))).alias("safety"), "g")
    stats = rows.agg(*[f(x).alias(f"{n}_{x}") for x in "rm" for n, f in (("avg", F.avg), ("sd", F.stddev_samp))])
    zs = {x: ratio(c(x) - c(f"avg_{x}"), c(f"sd_{x}")) for x in "rm"}
    return rows.join(F.broadcast(stats)).select(
        "ticker", six(R.mean_of_present(zs["r"], zs["m"])).alias("quality_z"), six(0.5 * F.coalesce(zs["r"], F.lit(0.0)) + 0.2 * c("g") + 0.3 * c("safety")).alias("qmj")
    )


@query(f"""WITH {_CO} SELECT ticker, period, round(-((ttm - ttm_before) - (cost - cost_before) - tax) / nullif((ttm + ttm_before) / 2, 0), 6) AS accruals FROM companies WHERE ttm_before IS NOT NULL""")
def f19_accruals(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    score = N.accruals(c("ttm") - c("ttm_before"), c("cost") - c("cost_before"), F.lit(0.0), c("tax"), (c("ttm") + c("ttm_before")) / 2)
    return N.companies(V.fundamentals(spark, d)).where("ttm_before IS NOT NULL").select("ticker", "period", six(score).alias("accruals"))


@query(f"""WITH {_CO}, h AS (SELECT ticker, period, surprise, stddev_samp(surprise) OVER p AS sd, count(surprise) OVER p AS n FROM companies WINDOW p AS (PARTITION BY ticker ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ticker, period, round(CASE WHEN n > 2 AND sd > 0 THEN least(2, greatest(-2, surprise)) / sd ELSE least(2, greatest(-2, surprise)) END * exp(-ln(2) * 20 / 30), 6) AS pead FROM h WHERE surprise IS NOT NULL""")
def f22_earnings_drift(spark: SparkSession, d: str) -> DataFrame:
    """Twenty days after each quarter's figures."""
    p = Window.partitionBy("ticker").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    rows = N.companies(V.fundamentals(spark, d)).select("ticker", "period", "surprise", F.stddev_samp("surprise").over(p).alias("sd"), F.count("surprise").over(p).alias("n"))
    return rows.where("surprise IS NOT NULL").select("ticker", "period", six(N.earnings_drift(F.col("surprise"), F.col("sd"), F.col("n"), F.lit(20))).alias("pead"))


@query(f"""WITH {_CO} SELECT ticker, period, round(0.5*least(1, greatest(-1, yoy)) + 0.3*least(1, greatest(-1, ttm/nullif(ttm_before,0)-1)) + 0.2*least(1, greatest(-1, surprise)), 6) AS momentum,
round((cost - cost_before) / nullif(abs(cost_before), 0), 6) AS revision FROM companies WHERE surprise IS NOT NULL AND ttm_before IS NOT NULL""")
def f23_earnings_momentum(spark: SparkSession, d: str) -> DataFrame:
    """F23 and F24."""
    c = F.col
    rows = N.companies(V.fundamentals(spark, d)).where("surprise IS NOT NULL AND ttm_before IS NOT NULL")
    return rows.select("ticker", "period", six(N.earnings_momentum(c("yoy"), ratio(c("ttm"), c("ttm_before")) - 1, c("surprise"))).alias("momentum"), six(N.revision(c("cost"), c("cost_before"))).alias("revision"))


def _has(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")"


_HEAD = f"(({_has(N.LIFT)} - {_has(N.LOWER)}) / ({_has(N.LIFT)} + {_has(N.LOWER)} + 1)::DOUBLE)"


@query(f"""WITH n AS (SELECT doc_id % 10 + 1 AS ticker, doc_id, lower(coalesce(text, '')) AS low, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id DESC) AS k FROM documents),
s AS (SELECT ticker, sum((1 - 0.5 * (k - 1) / 9) * {_HEAD}) / sum(1 - 0.5 * (k - 1) / 9) AS s, count(*) AS n FROM n WHERE k <= 10 GROUP BY 1) SELECT ticker, n, round(s * (0.5 + 0.5 * least(1, n / 5)), 6) AS sentiment FROM s""")
def f25_news_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """F25 and H13, over whole headlines; the ten newest a ticker are the factor's definition."""
    return N.sentiment(V.news(spark, d)).withColumn("sentiment", six(F.col("sentiment")))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM documents),
c AS (SELECT doc_id, k // 400 AS chunk, lower(string_agg(word, ' ' ORDER BY k)) AS low FROM w GROUP BY 1, 2) SELECT doc_id, count(*) AS chunks, round(avg({_HEAD}), 6) AS sentiment FROM c GROUP BY 1""")
def f26_transcript_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Over all chunks of a text, not its first ones alone."""
    return N.transcript_sentiment(V.table(spark, d, "documents")).withColumn("sentiment", six(F.col("sentiment")))


@query(f"""WITH {_ONE}, v AS (SELECT ticker, flow, price, flow * ((1.05/1.09) * (1 - pow(1.05/1.09, 5)) / (1 - 1.05/1.09) + pow(1.05/1.09, 5) * 1.02 / 0.07) AS dcf FROM one)
SELECT ticker, round(dcf, 4) AS dcf, round(0.5 * (dcf / nullif(price, 0) - 1) + 0.5 * flow / nullif(price, 0), 6) AS composite, round(flow / nullif(price, 0) - 0.042, 6) AS yield_spread FROM v""")
def f27_valuation_composite(spark: SparkSession, d: str) -> DataFrame:
    """F27 over VA1."""
    c = F.col
    rows = one(spark, d).withColumn("dcf", N.dcf_flat(c("flow"), 0.05, 0.09, 0.02, 5))
    return rows.select("ticker", F.round("dcf", 4).alias("dcf"), six(0.5 * (ratio(c("dcf"), c("price")) - 1) + 0.5 * ratio(c("flow"), c("price"))).alias("composite"), six(ratio(c("flow"), c("price")) - 0.042).alias("yield_spread"))


def _fade(years: int) -> str:
    """The DCF of one fading row, unrolled."""
    grown, terms = [], []
    for t in range(1, years + 1):
        grown.append(f"(1 + gg + (0.02 - gg) * {t - 1} / {years - 1}.0)")
        terms.append(f"flow * {' * '.join(grown)} / pow(1 + disc, {t})")
    return f"({' + '.join(terms)} + flow * {' * '.join(grown)} * 1.02 / (disc - 0.02) / pow(1 + disc, {years}))"


@query(f"""WITH {_ONE}, m AS (SELECT *, least(0.25, greatest(-0.05, g)) AS gg, (1 - 0.3 * lev) * (0.042 + (0.67 * (1 + lev) + 0.33) * 0.05) + 0.3 * lev * 0.05 * 0.79 AS disc FROM one), f AS (SELECT *, {_fade(5)} AS five, {_fade(10)} AS ten FROM m)
SELECT ticker, round(disc, 6) AS wacc, round(five, 4) AS dcf5, round(ten, 4) AS dcf10, CASE WHEN five/price-1 > 0.3 THEN 'strong buy' WHEN five/price-1 > 0.1 THEN 'buy' WHEN five/price-1 > -0.1 THEN 'hold' WHEN five/price-1 > -0.25 THEN 'sell' ELSE 'strong sell' END AS rating,
CASE WHEN price/five < 0.85 THEN 'strong buy' WHEN price/five < 0.9 THEN 'buy' WHEN price/five > 1.15 THEN 'sell' ELSE 'hold' END AS by_range FROM f""")
def va2_discounted_flows(spark: SparkSession, d: str) -> DataFrame:
    """VA2, VA5, VA6, H22-H24."""
    c = F.col
    rows = one(spark, d).withColumns({"gg": F.greatest(F.lit(-0.05), F.least(F.lit(0.25), c("g"))), "disc": N.wacc(1 + c("lev"), 0.3 * c("lev"), 1 - 0.3 * c("lev"))})
    rows = rows.withColumns({"five": N.dcf(c("flow"), c("gg"), c("disc")), "ten": N.dcf(c("flow"), c("gg"), c("disc"), years=10)})
    return rows.select("ticker", six(c("disc")).alias("wacc"), F.round("five", 4).alias("dcf5"), F.round("ten", 4).alias("dcf10"), N.rating(c("five"), c("price")).alias("rating"), N.rating_by_range(c("five"), c("price")).alias("by_range"))


@query(f"""WITH {_ONE}, k AS (SELECT *, CASE ticker % 4 WHEN 0 THEN 'industrial' WHEN 1 THEN 'retail' WHEN 2 THEN 'office' ELSE 'residential' END AS kind FROM one)
SELECT ticker, round(CASE WHEN flow * 0.4 > 0 AND 0.03 < 0.09 THEN flow * 0.4 * 1.03 / 0.06 ELSE book + book * (flow / book - 0.09) / 0.09 END, 4) AS ddm,
round(flow * CASE kind WHEN 'industrial' THEN 22.0 WHEN 'residential' THEN 19.0 WHEN 'retail' THEN 14.0 WHEN 'office' THEN 12.0 ELSE 16.0 END, 4) AS reit,
round(CASE WHEN flow > 0 AND book > 0 THEN sqrt(22.5 * flow * book) END, 4) AS graham FROM k""")
def va3_other_models(spark: SparkSession, d: str) -> DataFrame:
    """VA3, VA4 and VA11."""
    c = F.col
    kind = F.when(c("ticker") % 4 == 0, "industrial").when(c("ticker") % 4 == 1, "retail").when(c("ticker") % 4 == 2, "office").otherwise("residential")
    return one(spark, d).select(
        "ticker", F.round(N.dividend_discount(c("flow") * 0.4, F.lit(0.03), F.lit(0.09), c("book"), ratio(c("flow"), c("book"))), 4).alias("ddm"),
        F.round(N.reit(c("flow"), kind), 4).alias("reit"), F.round(N.graham(c("flow"), c("book")), 4).alias("graham"),
    )


@query(f"""WITH {_ONE}, s AS (SELECT unnest([-0.01, 0.0, 0.01]::DOUBLE[]) AS dg), r AS (SELECT unnest([-0.01, 0.0, 0.01]::DOUBLE[]) AS dr)
SELECT ticker, round(0.05 + dg, 4) AS growth, round(0.09 + dr, 4) AS discount, round(flow * (((1.05+dg)/(1.09+dr)) * (1 - pow((1.05+dg)/(1.09+dr), 5)) / (1 - (1.05+dg)/(1.09+dr)) + pow((1.05+dg)/(1.09+dr), 5) * 1.02 / (0.07 + dr)), 4) AS dcf FROM one, s, r""")
def va7_sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    """A 3 x 3 grid a company, as an array of the nine cases on each row."""
    cases = [(g, r) for g in (-0.01, 0.0, 0.01) for r in (-0.01, 0.0, 0.01)]
    grid = F.array(*[F.struct(F.lit(round(0.05 + g, 4)).alias("growth"), F.lit(round(0.09 + r, 4)).alias("discount"), F.round(N.dcf_flat(F.col("flow"), 0.05 + g, 0.09 + r, 0.02, 5), 4).alias("dcf")) for g, r in cases])
    return one(spark, d).select("ticker", F.explode(grid).alias("x")).select("ticker", "x.*")


@query(f"""WITH RECURSIVE {_ONE}, b AS (SELECT ticker, flow, price, -0.2::DOUBLE AS lo, 0.5::DOUBLE AS hi, 0 AS n FROM one UNION ALL
SELECT ticker, flow, price, CASE WHEN w < price THEN mid ELSE lo END, CASE WHEN w < price THEN hi ELSE mid END, n + 1 FROM (SELECT *, flow * (q + pow(q,2) + pow(q,3) + pow(q,4) + pow(q,5) + pow(q,5) * 1.02 / 0.07) AS w FROM (
SELECT *, (lo + hi) / 2 AS mid, (1 + (lo + hi) / 2) / 1.09 AS q FROM b)) WHERE n < 20) SELECT ticker, round((lo + hi) / 2, 6) AS implied FROM b WHERE n = 20""")
def va8_implied_growth(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d).select("ticker", six(N.implied_growth(F.col("flow"), F.col("price"))).alias("implied"))


@query(f"""WITH {_ONE}, r AS (SELECT ticker, book, least(0.3, flow / book) AS roe FROM one), p AS (SELECT *, 1 + roe * 0.6 AS h, roe - 0.08 AS x FROM r)
SELECT ticker, round(book + book*x*(1/1.08 + h/pow(1.08,2) + pow(h,2)/pow(1.08,3) + pow(h,3)/pow(1.08,4) + pow(h,4)/pow(1.08,5)) + book*pow(h,4)*x/0.08/pow(1.08,5), 4) AS rim FROM p""")
def va9_residual_income(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d).select("ticker", F.round(N.residual_income(F.col("book"), ratio(F.col("flow"), F.col("book"))), 4).alias("rim"))


@query(f"""WITH {_CO} SELECT ticker, period, {sixes('yoy')}, round((revenue - cost) / nullif(revenue, 0), 6) AS margin, round(tax / nullif(revenue, 0), 6) AS tax_rate, round(units / nullif(orders, 0), 6) AS units_per_order FROM companies""")
def va10_derived_ratios(spark: SparkSession, d: str) -> DataFrame:
    """VA10 and H37."""
    c = F.col
    return N.companies(V.fundamentals(spark, d)).select(
        "ticker", "period", six(c("yoy")).alias("yoy"), six(ratio(c("revenue") - c("cost"), c("revenue"))).alias("margin"), six(ratio(c("tax"), c("revenue"))).alias("tax_rate"), six(ratio(c("units"), c("orders"))).alias("units_per_order")
    )
