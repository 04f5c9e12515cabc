"""Data quality: rules as columns, issues as rows, repairs as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import by_ticker, last_n, so_far, whole
from tidemark.shared import checkpointed

#: The columns of a bar, and what is done about each kind of issue.
REQUIRED = ("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")
ACTIONS = {
    "high_lt_low": "drop", "high_lt_open": "drop", "high_lt_close": "drop", "low_gt_open": "drop", "low_gt_close": "drop",
    "price_not_positive": "drop", "volume_not_positive": "drop", "gap_short": "interpolate", "gap_long": "warn",
    "potential_spike": "warn", "confirmed_spike": "drop", "persistent_move": "warn", "missing_column": "drop",
}
#: The columns that an issue of a row is about.
CONCERNS = {
    "high_lt_low": ("high", "low"), "high_lt_open": ("high", "open"), "high_lt_close": ("high", "close"), "low_gt_open": ("low", "open"), "low_gt_close": ("low", "close"),
    "price_not_positive": ("open", "high", "low", "close"), "volume_not_positive": ("volume",),
}
#: Largest return and deviations from the mean that pass, and the spread where none can be had.
JUMP, DEVIATIONS, NO_SPREAD = 0.5, 5.0, 0.02


def missing_columns(bars: DataFrame) -> list[str]:
    """Required columns that a frame lacks; rules need all."""
    return [c for c in REQUIRED if c not in bars.columns]


def _rules() -> dict[str, Column]:
    c = F.col
    return {
        "high_lt_low": c("high") < c("low"), "high_lt_open": c("high") < c("open"), "high_lt_close": c("high") < c("close"),
        "low_gt_open": c("low") > c("open"), "low_gt_close": c("low") > c("close"),
        "price_not_positive": F.coalesce(F.least("open", "high", "low", "close"), F.lit(0.0)) <= 0, "volume_not_positive": F.coalesce(c("volume"), F.lit(0)) <= 0,
    }


def row_issues(bars: DataFrame) -> DataFrame:
    """ticker, date, issue: all rules of a row in one pass."""
    found = F.array(*[F.when(broken, F.lit(name)) for name, broken in _rules().items()])
    return bars.select("ticker", "date", F.explode(F.array_compact(found)).alias("issue"))


def spike_issues(bars: DataFrame, backfill: bool = True) -> DataFrame:
    """ticker, date, issue: returns beyond JUMP or DEVIATIONS of the last 20 (5 at least, else the whole series).

    In a backfill a spike that the next return takes back by half at least is confirmed, any other is a persistent move.
    """
    w, all_ = last_n(20), whole("ticker")
    rows = bars.withColumn("ret", ratio(F.col("close"), F.lag("close").over(by_ticker())) - 1)
    n = F.count("ret").over(w)
    mean = F.when(n >= 5, F.avg("ret").over(w)).otherwise(F.avg("ret").over(all_))
    sd = F.when(n >= 5, F.stddev_samp("ret").over(w)).otherwise(F.stddev_samp("ret").over(all_))
    sd = F.when(F.coalesce(sd, F.lit(0.0)) == 0, NO_SPREAD).otherwise(sd)
    rows = rows.withColumns({"z": F.abs(F.col("ret") - mean) / sd, "then": F.lead("ret").over(by_ticker())})
    taken_back = (F.sign("then") == -F.sign("ret")) & (F.abs("then") >= 0.5 * F.abs("ret"))
    kind = F.when(F.coalesce(taken_back, F.lit(False)), "confirmed_spike").otherwise("persistent_move") if backfill else F.lit("potential_spike")
    return rows.where((F.col("z") > DEVIATIONS) | (F.abs("ret") > JUMP)).select("ticker", "date", kind.alias("issue"))


def gap_issues(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, first_date, last_date, days, issue: runs of expected days without a bar, joined where 3 days apart at most."""
    held = bars.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.collect_set("date").alias("have"))
    days = calendar.agg(F.sort_array(F.collect_set("date")).alias("days"))
    gone = held.join(F.broadcast(days)).select("ticker", F.explode(F.filter(F.array_except("days", "have"), lambda x: x.between(F.col("lo"), F.col("hi")))).alias("date"))
    far = F.datediff("date", F.lag("date").over(by_ticker())) > 3
    runs = gone.withColumn("run", F.sum(F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).over(so_far()))
    found = runs.groupBy("ticker", "run").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("days"))
    return found.select("ticker", "first_date", "last_date", "days", F.when(F.col("days") <= 3, "gap_short").otherwise("gap_long").alias("issue"))


def with_actions(issues: DataFrame) -> DataFrame:
    """Issues with the action that the policy names."""
    policy = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return issues.withColumn("action", F.element_at(policy, F.col("issue")))


def report(bars: DataFrame, issues: DataFrame) -> DataFrame:
    """ticker, bars, dropped, warned, drop_rate, passed: a row a ticker."""
    dropped = issues.where("action = 'drop'").select("ticker", "date").distinct().groupBy("ticker").agg(F.count("*").alias("dropped"))
    warned = issues.where("action = 'warn'").groupBy("ticker").agg(F.count("*").alias("warned"))
    out = bars.groupBy("ticker").agg(F.count("*").alias("bars")).join(dropped, "ticker", "left").join(warned, "ticker", "left").na.fill(0, ["dropped", "warned"])
    return out.withColumn("drop_rate", F.col("dropped") / F.col("bars")).withColumn("passed", F.col("drop_rate") <= 0.1)


def repaired(bars: DataFrame, issues: DataFrame) -> DataFrame:
    """Bars without the rows that issues drop."""
    return bars.join(issues.where("action = 'drop'").select("ticker", "date").distinct(), ["ticker", "date"], "left_anti")


def first_stage(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, issue, n: of the stages structure, rows, gaps and spikes the first that finds anything about a ticker, and no later one.

    A frame without all required columns has one issue and is not looked at further. Gaps are dated by their first day.
    """
    if gone := missing_columns(bars):
        return bars.sparkSession.createDataFrame([(None, f"missing_column:{c}", 1) for c in gone], "ticker long, issue string, n long")
    stages = [row_issues(bars), gap_issues(bars, calendar).select("ticker", "issue"), spike_issues(bars)]
    counts = [s.groupBy("ticker", "issue").agg(F.count("*").alias("n")).withColumn("stage", F.lit(k)) for k, s in enumerate(stages)]
    rows = counts[0].union(counts[1]).union(counts[2])
    return rows.withColumn("first", F.min("stage").over(whole("ticker"))).where("stage = first").select("ticker", "issue", "n")


def filled_in(bars: DataFrame, issues: DataFrame) -> DataFrame:
    """Bars with every action taken: columns to interpolate lie on the line between their neighbours, volumes to fill take the last one, then rows to drop go.

    Prices that an issue is not about, or that are positive where the issue is that one isn't, stay; so do a ticker's first
    and last row. A volume is filled where it is null and never interpolated. Faults side by side are bridged together.
    """
    taken = issues.groupBy("ticker", "date").agg(F.collect_set(F.struct("action", "issue")).alias("_taken"))
    rows = bars.join(taken, ["ticker", "date"], "left").withColumn("_drop", F.coalesce(F.exists("_taken", lambda x: x["action"] == "drop"), F.lit(False)))
    order, back = by_ticker(), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    rows = rows.withColumn("_inner", (F.row_number().over(order) > 1) & (back > 1))
    prices = ("open", "high", "low", "close")
    holes = {}
    for c in prices:
        about = [i for i, columns in CONCERNS.items() if c in columns and i != "price_not_positive"]
        of = F.exists("_taken", lambda x: (x["action"] == "interpolate") & (x["issue"].isin(about) | ((x["issue"] == "price_not_positive") & (F.coalesce(F.col(c), F.lit(0.0)) <= 0))))  # noqa: B023
        holes[c] = F.when(F.coalesce(of, F.lit(False)) & F.col("_inner") & ~F.col("_drop"), F.lit(None).cast("double")).otherwise(F.col(c))
    rows = rows.withColumns({f"_was_{c}": F.col(c) for c in prices}).withColumns(holes)
    rows = interpolated(rows, *prices).withColumns({c: F.coalesce(F.col(c), F.col(f"_was_{c}")) for c in prices})
    wanted = F.coalesce(F.exists("_taken", lambda x: (x["action"] == "ffill") & (x["issue"] == "volume_not_positive")), F.lit(False))
    rows = rows.withColumn("volume", F.when(wanted & ~F.col("_drop") & F.col("volume").isNull(), F.last("volume", ignorenulls=True).over(so_far())).otherwise(F.col("volume")))
    return rows.where(~F.col("_drop")).select(bars.columns)


def fit_for_store(fetched: DataFrame) -> DataFrame:
    """ticker, failed: a ticker fails as a whole if a row lacks a price, so that it can't stop the others."""
    return fetched.groupBy("ticker").agg(F.bool_or(F.least(*[F.col(c).isNotNull().cast("int") for c in ("open", "high", "low", "close")]) == 0).alias("failed"))


def caught_up(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fetched`` to append, and ticker, status, added, dropped: checked as a backfill, repaired, failures kept apart, in one pass for all tickers."""
    fit = fit_for_store(fetched)
    sound = fetched.join(fit.where("NOT failed"), "ticker", "left_semi")
    clean = checkpointed(repaired(sound, with_actions(row_issues(sound).union(spike_issues(sound)))))  # stored and counted
    added = clean.groupBy("ticker").agg(F.count("*").alias("added"))
    rows = fetched.groupBy("ticker").agg(F.count("*").alias("rows")).join(fit, "ticker").join(added, "ticker", "left").na.fill(0, ["added"])
    dropped = F.when(F.col("failed"), F.lit(0)).otherwise(F.col("rows") - F.col("added"))
    return clean, rows.select("ticker", F.when(F.col("failed"), "failed").otherwise("updated").alias("status"), "added", dropped.alias("dropped"))


def interpolated(rows: DataFrame, *values: str) -> DataFrame:
    """Nulls between two values on the line between them by row; before the first and after the last stay null.

    The next value is the last one in the opposite order: a frame to the end would be read anew for every row.
    """
    after = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_k", F.row_number().over(by_ticker()))
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), F.col("_k").alias("k"))) for v in values}
    rows = rows.withColumns({f"_a_{v}": F.last(x, ignorenulls=True).over(so_far()) for v, x in known.items()})
    rows = rows.withColumns({f"_b_{v}": F.last(x, ignorenulls=True).over(after) for v, x in known.items()})
    for v in values:
        a, b = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        line = a["v"] + (b["v"] - a["v"]) * ratio(F.col("_k") - a["k"], b["k"] - a["k"])
        rows = rows.withColumn(v, F.coalesce(F.col(v), line))
    return rows.drop("_k", *[f"_{x}_{v}" for v in values for x in "ab"])


def calendar(first: str, last: str, holidays: list[str] | None = None) -> Column:
    """The weekdays from first to last, less holidays, as an array to explode."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    off = F.array(*[F.lit(h).cast("date") for h in holidays or []]).cast("array<date>")
    return F.filter(days, lambda x: (F.weekday(x) < 5) & ~F.array_contains(off, x))


def trading(day: Column, holidays: list[str] | None = None) -> Column:
    """Whether a day is a weekday and no holiday."""
    off = F.array(*[F.lit(h).cast("date") for h in holidays or []]).cast("array<date>")
    return (F.weekday(day) < 5) & ~F.array_contains(off, day)


def neighbours(day: Column, holidays: list[str] | None = None, reach: int = 10) -> tuple[Column, Column]:
    """The trading days before and after a day, sought among ``reach`` days; the day beside it where there is none."""
    before = F.filter(F.sequence(F.date_sub(day, reach), F.date_sub(day, 1)), lambda x: trading(x, holidays))
    after = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, reach)), lambda x: trading(x, holidays))
    return F.coalesce(F.array_max(before), F.date_sub(day, 1)), F.coalesce(F.array_min(after), F.date_add(day, 1))


def outdated(bars: DataFrame, today: str, most: int = 30) -> DataFrame:
    """ticker, last_date, gap_days, fetch_from: where to fetch from; a gap of over ``most`` days starts 60 days back."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    gap = F.datediff(F.date_sub(F.lit(today).cast("date"), 1), "last_date")
    start = F.when(gap > most, F.date_sub(F.lit(today).cast("date"), 60)).otherwise(F.date_add("last_date", 1))
    return last.select("ticker", "last_date", gap.alias("gap_days"), F.when(gap > 0, start).alias("fetch_from"))
