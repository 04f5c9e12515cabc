"""Fundamental scores and valuation models as Column expressions over one row a company."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, interp, ratio


def quality(roe: Column, margin: Column, leverage: Column) -> Column:
    """0.4 of return on equity (0-30 %), 0.3 of gross margin (0-60 %) and 0.3 of low debt to equity (0-2)."""
    return 0.4 * interp(roe, 0.0, 0.30) + 0.3 * interp(margin, 0.0, 0.60) + 0.3 * (100 - interp(leverage, 0.0, 2.0))


def value(pe: Column, pb: Column) -> Column:
    """0.6 of a low price to earnings (10-50) and 0.4 of a low price to book (1-10); losses count as the dearest."""
    return 0.6 * (100 - interp(F.when(pe <= 0, 50.0).otherwise(pe), 10.0, 50.0)) + 0.4 * (100 - interp(F.when(pb <= 0, 10.0).otherwise(pb), 1.0, 10.0))


def growth(revenue: Column, earnings: Column) -> Column:
    """Half of each growth, on 0 to 30 %."""
    return 0.5 * interp(revenue, 0.0, 0.30) + 0.5 * interp(earnings, 0.0, 0.30)


def accruals(d_assets: Column, d_cash: Column, d_liabilities: Column, depreciation: Column, average_assets: Column) -> Column:
    """Minus accruals over average assets."""
    return -ratio((d_assets - d_cash) - d_liabilities - depreciation, average_assets)


def earnings_drift(surprise: Column, history_sd: Column, observations: Column, days: Column) -> Column:
    """Standardised surprise (surprise within 200 %, over its history's spread from three observations on), halved every 30 days, gone after 60."""
    s = clip(surprise, -2.0, 2.0)
    sue = F.when((observations > 2) & (history_sd > 0), s / F.nullif(history_sd, F.lit(0.0))).otherwise(s)
    return F.when(days > 60, 0.0).otherwise(sue * F.exp(-0.6931471805599453 * days / 30))


def earnings_momentum(eps: Column, revenue: Column, trajectory: Column) -> Column:
    return 0.5 * clip(eps, -1.0, 1.0) + 0.3 * clip(revenue, -1.0, 1.0) + 0.2 * clip(trajectory, -1.0, 1.0)


def revision(now: Column, before: Column) -> Column:
    """Change of an estimate over its size."""
    return ratio(now - before, F.abs(before))


def wacc(beta: Column, debt: Column, equity: Column, rate: float = 0.042, premium: float = 0.05, cost_of_debt: Column | None = None, tax: Column | None = None) -> Column:
    """Weighted cost of capital: beta drawn to 1, cost of debt in 3-10 %, tax in 0-25 %."""
    cost = rate + (0.67 * beta + 0.33) * premium
    share = F.coalesce(ratio(debt, debt + equity), F.lit(0.0))
    of_debt = clip(F.lit(0.05) if cost_of_debt is None else cost_of_debt, 0.03, 0.10) * (1 - clip(F.lit(0.21) if tax is None else tax, 0.0, 0.25))
    return (1 - share) * cost + share * of_debt


def dcf(flow: Column, growth_: Column, discount: Column, terminal: float = 0.02, years: int = 5) -> Column:
    """Present value of a flow whose growth fades in a line to the terminal rate, and of what follows by Gordon's formula."""
    zero = F.struct(flow.alias("f"), F.lit(0.0).alias("pv"), F.lit(1.0).alias("d"))

    def step(a: Column, t: Column) -> Column:
        rate = growth_ + (terminal - growth_) * (t - 1) / (years - 1)
        f, d = a["f"] * (1 + rate), a["d"] * (1 + discount)
        return F.struct(f.alias("f"), (a["pv"] + f / d).alias("pv"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(years)), zero, step, lambda a: a["pv"] + ratio(a["f"] * (1 + terminal), discount - terminal) / a["d"])


def dcf_flat(flow: Column, growth_: float, discount: float, terminal: float, years: int) -> Column:
    """The same with one growth rate, in closed form."""
    q = (1 + growth_) / (1 + discount)
    stage = flow * q * (1 - q**years) / (1 - q)
    return stage + flow * q**years * (1 + terminal) / (discount - terminal)


def dividend_discount(dividend: Column, growth_: Column, cost: Column, book: Column, roe: Column) -> Column:
    """Gordon's value where growth is below the cost of equity, else book value and its excess return."""
    gordon = ratio(dividend * (1 + growth_), cost - growth_)
    return F.when((dividend > 0) & (growth_ < cost), gordon).otherwise(book + ratio(book * (roe - cost), cost))


def reit(ffo: Column, kind: Column) -> Column:
    """Funds from operations at the multiple of the kind of property."""
    return ffo * F.when(kind == "industrial", 22.0).when(kind == "residential", 19.0).when(kind == "retail", 14.0).when(kind == "office", 12.0).otherwise(16.0)


def rating(fair: Column, price: Column) -> Column:
    """Ladder of upside."""
    up = ratio(fair, price) - 1
    return F.when(up > 0.30, "strong buy").when(up > 0.10, "buy").when(up > -0.10, "hold").when(up > -0.25, "sell").otherwise("strong sell")


def rating_by_range(fair: Column, price: Column) -> Column:
    """Ladder of price as a share of fair value."""
    at = ratio(price, fair)
    return F.when(at < 0.85, "strong buy").when(at < 0.90, "buy").when(at > 1.15, "sell").otherwise("hold")


def implied_growth(flow: Column, price: Column, discount: float = 0.09, terminal: float = 0.02, years: int = 5, steps: int = 20) -> Column:
    """The growth at which the flat model gives the price, by bisection between -20 and 50 %."""
    zero = F.struct(F.lit(-0.20).alias("lo"), F.lit(0.50).alias("hi"))

    def worth(g: Column) -> Column:
        q = (1 + g) / (1 + discount)
        powers = sum((F.pow(q, F.lit(k)) for k in range(1, years + 1)), F.lit(0.0))
        return flow * (powers + F.pow(q, F.lit(years)) * (1 + terminal) / (discount - terminal))

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        low = worth(mid) < price
        return F.struct(F.when(low, mid).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step, lambda a: (a["lo"] + a["hi"]) / 2)


def residual_income(book: Column, roe: Column, cost: float = 0.08, years: int = 5, payout: float = 0.4) -> Column:
    """Book value and five years of return above cost (return at most 30 %), the last for ever."""
    r = F.least(roe, F.lit(0.30))
    zero = F.struct(book.alias("b"), F.lit(0.0).alias("pv"), F.lit(0.0).alias("ri"))

    def step(a: Column, t: Column) -> Column:
        ri = a["b"] * (r - cost)
        return F.struct((a["b"] * (1 + r * (1 - payout))).alias("b"), (a["pv"] + ri / F.pow(F.lit(1 + cost), t)).alias("pv"), ri.alias("ri"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(years)), zero, step, lambda a: book + a["pv"] + a["ri"] / cost / (1 + cost) ** years)


def graham(eps: Column, book: Column) -> Column:
    """Graham's number; null for losses or negative book."""
    return F.when((eps > 0) & (book > 0), F.sqrt(22.5 * eps * book))


def companies(fundamentals: DataFrame) -> DataFrame:
    """Each quarter with the figures that models ask for: trailing sums, growth on the year before, spread of surprises."""
    w = Window.partitionBy("ticker").orderBy("period")
    year = w.rowsBetween(-3, 0)
    rows = fundamentals.withColumns({
        "ttm": F.sum("revenue").over(year), "ttm_cost": F.sum("cost").over(year), "quarters": F.count("*").over(year), "revenue_before": F.lag("revenue", 4).over(w),
    })
    rows = rows.withColumn("yoy", ratio(F.col("revenue"), F.col("revenue_before")) - 1)
    return rows.withColumns({"surprise": F.col("yoy") - F.lag("yoy").over(w), "ttm_before": F.lag("ttm", 4).over(w), "cost_before": F.lag("cost", 4).over(w)}).where("quarters = 4")


#: Words that lift and lower a headline.
LIFT = (
    "beat", "beats", "surge", "surges", "gain", "gains", "profit", "profits", "growth", "grow", "rise", "rises", "rising", "up", "high", "higher", "bullish", "upgrade", "upgraded",
    "strong", "outperform", "buy", "record", "breakthrough", "innovation", "success", "positive", "boost", "boosted", "jump", "jumps", "soar", "soars", "rally", "optimistic",
    "confidence", "exceed", "exceeds", "exceeded",
)
LOWER = (
    "miss", "misses", "fall", "falls", "drop", "drops", "loss", "losses", "decline", "declines", "down", "low", "lower", "weak", "bearish", "downgrade", "downgraded", "sell",
    "underperform", "cut", "cuts", "warning", "concern", "concerns", "risk", "risks", "slump", "crash", "plunge", "plunges", "tumble", "tumbles", "slide", "pessimistic",
    "disappointing", "disappoints", "layoff", "layoffs",
)


def headline_score(text: Column, lift: tuple[str, ...] = LIFT, lower: tuple[str, ...] = LOWER) -> Column:
    """(lifting - lowering) of the words that a text holds anywhere, over their number and one."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def held(words: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)))

    up, down = held(lift), held(lower)
    return (up - down) / (up + down + 1)


def sentiment(news: DataFrame, most: int = 10) -> DataFrame:
    """ticker, sentiment: the newest headlines (doc_id order) weighted from 1 down to 0.5, drawn to half for few of them."""
    rows = news.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("doc_id")))).where(F.col("k") <= most)
    weight = 1 - 0.5 * (F.col("k") - 1) / (most - 1)
    out = rows.groupBy("ticker").agg((F.sum(weight * headline_score(F.col("text"))) / F.sum(weight)).alias("s"), F.count("*").alias("n"))
    return out.select("ticker", "n", (F.col("s") * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("n") / 5))).alias("sentiment"))


def transcript_sentiment(docs: DataFrame, words: int = 400) -> DataFrame:
    """doc_id, chunks, sentiment: the mean score of a text's chunks of 400 words."""
    found = F.posexplode(F.flatten(F.transform(F.array(F.split("text", " ")), lambda w: _chunks(w, words, _found))))
    parts = docs.where("text IS NOT NULL").select("doc_id", found.alias("chunk", "found"))
    # the chunks of rows with one doc_id are read as one text's
    parts = parts.groupBy("doc_id", "chunk").agg(*[F.bit_or(f"found.{c}").alias(c) for c in ("up", "down")])
    up, down = F.bit_count("up"), F.bit_count("down")
    return parts.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg((up - down) / (up + down + 1)).alias("sentiment"))


def _chunks(w: Column, words: int, told: Callable[[Column], Column]) -> Column:
    """What ``told`` says of each ``words`` words of an array, in order, without a row or a shuffle for any word."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / words).cast("int")), lambda k: told(F.array_join(F.slice(w, k * words + 1, words), " ")))


def _found(text: Column) -> Column:
    """The lifting and the lowering words that a text holds anywhere, a bit each."""

    def held(low: Column, words: tuple[str, ...]) -> Column:
        each = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(1 << k).cast("long").alias("bit")) for k, w in enumerate(words)])
        return F.aggregate(each, F.lit(0).cast("long"), lambda bits, x: F.when(low.contains(x["w"]), bits.bitwiseOR(x["bit"])).otherwise(bits))

    # an array of one, so that the text is put together and lowered once, not for every word
    return F.element_at(F.transform(F.array(F.lower(text)), lambda low: F.struct(held(low, LIFT).alias("up"), held(low, LOWER).alias("down"))), 1)
