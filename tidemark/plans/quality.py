"""Validation, repair and freshness of bars with planted faults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import six
from tidemark.functions.windows import by_ticker
from tidemark.operators import quality as Q
from tidemark.plans.registry import SQL, query
from tidemark.sources import views as V

_W = "PARTITION BY ticker ORDER BY date"
#: Faults by the place of a row: swapped prices, zero prices and volumes, spikes with and without reversal, removed days.
_FAULTY = f"""{V.BARS}, numbered AS (SELECT *, row_number() OVER ({_W}) AS k FROM bars),
faulty AS (SELECT ticker, date, CASE WHEN k % 97 = 5 THEN low * 0.9 WHEN k % 97 = 7 THEN open ELSE open END AS open, CASE WHEN k % 97 = 11 THEN low - 0.5 ELSE high END AS high,
CASE WHEN k % 97 = 13 THEN high + 0.5 ELSE low END AS low, CASE WHEN k % 97 = 17 THEN 0.0 WHEN k % 97 = 23 THEN close * 10 ELSE close END AS close, adj_close,
CASE WHEN k % 97 = 19 THEN 0.0 ELSE volume END AS volume, k FROM numbered WHERE k % 97 NOT IN (40, 41, 60, 61, 62, 63, 64))"""
_ISSUES = """issues AS (SELECT ticker, date, unnest(list_filter([CASE WHEN high < low THEN 'high_lt_low' END, CASE WHEN high < open THEN 'high_lt_open' END, CASE WHEN high < close THEN 'high_lt_close' END,
CASE WHEN low > open THEN 'low_gt_open' END, CASE WHEN low > close THEN 'low_gt_close' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'price_not_positive' END,
CASE WHEN volume <= 0 THEN 'volume_not_positive' END], lambda x: x IS NOT NULL)) AS issue FROM faulty)"""


def faulty(spark: SparkSession, d: str) -> DataFrame:
    """Bars with faults planted by place."""
    k = F.col("k") % 97
    rows = V.bars(spark, d).withColumn("k", F.row_number().over(by_ticker())).where(~k.isin(40, 41, 60, 61, 62, 63, 64))
    return rows.select(
        "ticker", "date", F.when(k == 5, F.col("low") * 0.9).otherwise(F.col("open")).alias("open"), F.when(k == 11, F.col("low") - 0.5).otherwise(F.col("high")).alias("high"),
        F.when(k == 13, F.col("high") + 0.5).otherwise(F.col("low")).alias("low"), F.when(k == 17, 0.0).when(k == 23, F.col("close") * 10).otherwise(F.col("close")).alias("close"), "adj_close",
        F.when(k == 19, 0.0).otherwise(F.col("volume")).alias("volume"), "k",
    )


@query(f"WITH {_FAULTY}, {_ISSUES} SELECT ticker, date, issue FROM issues")
def v04_row_rules(spark: SparkSession, d: str) -> DataFrame:
    """V02 and V04."""
    return Q.row_issues(faulty(spark, d))


@query(f"WITH {_FAULTY}, {_ISSUES} SELECT issue, count(*) AS n FROM issues GROUP BY 1")
def v08_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.row_issues(faulty(spark, d)).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"WITH {_FAULTY}, {_ISSUES} SELECT issue, ticker, date FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY ticker, date) AS n FROM issues) WHERE n <= 10")
def v03_first_ten_of_each(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.relational import top_k

    return top_k(Q.row_issues(faulty(spark, d)), ["issue"], [F.asc("ticker"), F.asc("date")], 10).select("issue", "ticker", "date")


_SPIKES = f"""r AS (SELECT *, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS ret FROM faulty),
s AS (SELECT *, lead(ret) OVER ({_W}) AS nxt, count(ret) OVER t AS n, avg(ret) OVER t AS m20, stddev_samp(ret) OVER t AS s20, avg(ret) OVER (PARTITION BY ticker) AS ma, stddev_samp(ret) OVER (PARTITION BY ticker) AS sa
FROM r WINDOW t AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, abs(ret - CASE WHEN n >= 5 THEN m20 ELSE ma END) / CASE WHEN coalesce(CASE WHEN n >= 5 THEN s20 ELSE sa END, 0) = 0 THEN 0.02 ELSE CASE WHEN n >= 5 THEN s20 ELSE sa END END AS z FROM s),
spikes AS (SELECT ticker, date, CASE WHEN sign(nxt) = -sign(ret) AND abs(nxt) >= 0.5 * abs(ret) THEN 'confirmed_spike' ELSE 'persistent_move' END AS issue FROM z WHERE z > 5 OR abs(ret) > 0.5)"""


@query(f"WITH {_FAULTY}, {_SPIKES} SELECT ticker, date, issue FROM spikes")
def v06_spikes(spark: SparkSession, d: str) -> DataFrame:
    """V06 and V07."""
    return Q.spike_issues(faulty(spark, d))


_GAPS = f"""days AS (SELECT DISTINCT date FROM bars), span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM faulty GROUP BY 1),
gone AS (SELECT ticker, date FROM span JOIN days ON date BETWEEN lo AND hi EXCEPT SELECT ticker, date FROM faulty),
gaps AS (SELECT ticker, run, min(date) AS first_date, max(date) AS last_date, count(*) AS days FROM (SELECT ticker, date, sum(opens) OVER ({_W}) AS run FROM (
SELECT *, CASE WHEN date - lag(date) OVER ({_W}) <= 3 THEN 0 ELSE 1 END AS opens FROM gone)) GROUP BY 1, 2)"""


@query(f"WITH {_FAULTY}, {_GAPS} SELECT ticker, first_date, last_date, days, CASE WHEN days <= 3 THEN 'gap_short' ELSE 'gap_long' END AS issue FROM gaps")
def v05_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps against the days on which any ticker has bars."""
    return Q.gap_issues(faulty(spark, d), V.bars(spark, d).select("date").distinct())


@query(f"""WITH {_FAULTY}, {_ISSUES}, {_SPIKES}, all_ AS (SELECT ticker, date, CASE WHEN issue = 'persistent_move' THEN 'warn' ELSE 'drop' END AS action FROM (SELECT * FROM issues UNION ALL SELECT * FROM spikes)),
dr AS (SELECT ticker, count(DISTINCT date) AS dropped FROM all_ WHERE action = 'drop' GROUP BY 1), wn AS (SELECT ticker, count(*) AS warned FROM all_ WHERE action = 'warn' GROUP BY 1), n AS (SELECT ticker, count(*) AS bars FROM faulty GROUP BY 1)
SELECT ticker, bars, coalesce(dropped, 0) AS dropped, coalesce(warned, 0) AS warned, round(coalesce(dropped, 0) / bars, 6) AS drop_rate, coalesce(dropped, 0) / bars <= 0.1 AS passed FROM n LEFT JOIN dr USING (ticker) LEFT JOIN wn USING (ticker)""")
def v08_report(spark: SparkSession, d: str) -> DataFrame:
    """V08, V11 and V12."""
    rows = faulty(spark, d)
    out = Q.report(rows, Q.with_actions(Q.row_issues(rows).union(Q.spike_issues(rows))))
    return out.withColumn("drop_rate", six(F.col("drop_rate")))


@query(f"""WITH {_FAULTY}, {_ISSUES}, bad AS (SELECT DISTINCT ticker, date FROM issues) SELECT ticker, count(*) AS bars, round(sum(close), 4) AS closes FROM faulty ANTI JOIN bad USING (ticker, date) GROUP BY 1""")
def v10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Bars without dropped rows, as a checksum a ticker."""
    rows = faulty(spark, d)
    return Q.repaired(rows, Q.with_actions(Q.row_issues(rows))).groupBy("ticker").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("closes"))


_HOLIDAYS = ["1998-01-01", "1998-07-03", "1998-12-25"]
_OFF = ", ".join(f"DATE '{h}'" for h in _HOLIDAYS)
_OPEN = f"lambda x: isodow(x) <= 5 AND CAST(x AS DATE) NOT IN ({_OFF})"


@query(f"""WITH {V.BARS}, dy AS (SELECT date, count(*) AS bars FROM bars GROUP BY 1) SELECT date, bars, isodow(date) <= 5 AND date NOT IN ({_OFF}) AS trading,
CAST(coalesce(list_max(list_filter(generate_series(date - INTERVAL 10 DAY, date - INTERVAL 1 DAY, INTERVAL 1 DAY), {_OPEN})), date - INTERVAL 1 DAY) AS DATE) AS previous,
CAST(coalesce(list_min(list_filter(generate_series(date + INTERVAL 1 DAY, date + INTERVAL 10 DAY, INTERVAL 1 DAY), {_OPEN})), date + INTERVAL 1 DAY) AS DATE) AS following FROM dy""")
def v13_calendar(spark: SparkSession, d: str) -> DataFrame:
    """For each day that has bars, whether it is a trading day, and the trading days beside it."""
    before, after = Q.neighbours(F.col("date"), _HOLIDAYS)
    days = V.bars(spark, d).groupBy("date").agg(F.count("*").alias("bars"))
    return days.select("date", "bars", Q.trading(F.col("date"), _HOLIDAYS).alias("trading"), before.alias("previous"), after.alias("following"))


@query(f"""WITH {V.BARS} SELECT ticker, max(date) AS last_date, CAST(DATE '2001-11-10' - 1 - max(date) AS INTEGER) AS gap_days,
CASE WHEN DATE '2001-11-10' - 1 - max(date) > 0 THEN CASE WHEN DATE '2001-11-10' - 1 - max(date) > 30 THEN DATE '2001-11-10' - 60 ELSE max(date) + 1 END END AS fetch_from FROM bars GROUP BY 1""")
def v14_gap_status(spark: SparkSession, d: str) -> DataFrame:
    """V14, V16, H03 and H05."""
    return Q.outdated(V.bars(spark, d), "2001-11-10")


@query(f"""WITH {V.BARS} SELECT max(date) AS newest, CAST(DATE '2001-11-10' - max(date) AS INTEGER) AS days_old, DATE '2001-11-10' - max(date) <= 7 AS fresh FROM bars""")
def v17_freshness(spark: SparkSession, d: str) -> DataFrame:
    old = F.datediff(F.lit("2001-11-10").cast("date"), F.max("date"))
    return V.bars(spark, d).agg(F.max("date").alias("newest"), old.alias("days_old"), (old <= 7).alias("fresh"))


@query(f"""WITH {_FAULTY}, {_ISSUES}, {_SPIKES}, {_GAPS}, st AS (SELECT ticker, issue, count(*) AS n, 0 AS stage FROM issues GROUP BY 1, 2 UNION ALL SELECT ticker, CASE WHEN days <= 3 THEN 'gap_short' ELSE 'gap_long' END, count(*), 1 FROM gaps GROUP BY 1, 2
UNION ALL SELECT ticker, issue, count(*), 2 FROM spikes GROUP BY 1, 2) SELECT ticker, issue, n FROM st s WHERE stage = (SELECT min(stage) FROM st t WHERE t.ticker = s.ticker)""")
def v09_fail_fast(spark: SparkSession, d: str) -> DataFrame:
    """The first stage that finds something about a ticker."""
    return Q.first_stage(faulty(spark, d), V.bars(spark, d).select("date").distinct())


@query("SELECT NULL::BIGINT AS ticker, unnest(['missing_column:adj_close', 'missing_column:volume']) AS issue, 1::BIGINT AS n")
def v01_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """A frame that lacks columns has that as its only issues."""
    bars = V.bars(spark, d)
    return Q.first_stage(bars.drop("adj_close", "volume"), bars.select("date").distinct())


#: What a lenient policy does: single bad prices and volumes are mended, rows that contradict themselves still go.
MENDED = {"price_not_positive": "interpolate", "low_gt_close": "interpolate", "volume_not_positive": "ffill"}


@query(f"""WITH {_FAULTY.replace('THEN 0.0 ELSE volume END', 'THEN 0.0 WHEN k % 97 = 29 THEN NULL ELSE volume END')}, {_ISSUES}, bad AS (SELECT DISTINCT ticker, date FROM issues WHERE issue NOT IN ('price_not_positive', 'low_gt_close', 'volume_not_positive')),
m AS (SELECT ticker, date, CASE WHEN close <= 0 THEN coalesce((lag(close) OVER w + lead(close) OVER w) / 2, close) ELSE close END AS close, CASE WHEN close <= 0 THEN coalesce((lag(low) OVER w + lead(low) OVER w) / 2, low) ELSE low END AS low,
coalesce(volume, lag(volume) OVER w) AS volume FROM faulty WINDOW w AS ({_W})) SELECT ticker, count(*) AS bars, round(sum(close), 4) AS closes, round(sum(low), 4) AS lows, sum(volume) AS volumes FROM m ANTI JOIN bad USING (ticker, date) GROUP BY 1""")
@V.bars_once
def v10_mended(spark: SparkSession, d: str) -> DataFrame:
    """V10 under a policy that interpolates prices and carries volumes on, as a checksum a ticker."""
    rows = faulty(spark, d).withColumn("volume", F.when(F.col("k") % 97 != 29, F.col("volume")))
    action = F.coalesce(*[F.when(F.col("issue") == i, a) for i, a in MENDED.items()], F.lit("drop"))
    fixed = Q.filled_in(rows, Q.row_issues(rows).withColumn("action", action))
    return fixed.groupBy("ticker").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("closes"), F.round(F.sum("low"), 4).alias("lows"), F.sum("volume").alias("volumes"))


@query(f"""WITH {_FAULTY}, fetched AS (SELECT * FROM faulty WHERE date >= DATE '2000-01-01' AND ticker % 10 <> 4), {_ISSUES.replace('FROM faulty', 'FROM fetched')}, {_SPIKES.replace('FROM faulty', 'FROM fetched')},
bad AS (SELECT ticker, date FROM issues UNION SELECT ticker, date FROM spikes WHERE issue = 'confirmed_spike'), a AS (SELECT ticker, count(*) AS added FROM fetched ANTI JOIN bad USING (ticker, date) GROUP BY 1),
f AS (SELECT ticker, count(*) AS n FROM faulty WHERE date >= DATE '2000-01-01' GROUP BY 1), h AS (SELECT ticker, count(*) AS held FROM bars WHERE date < DATE '2000-01-01' GROUP BY 1)
SELECT ticker, CASE WHEN ticker % 10 = 4 THEN 'failed' ELSE 'updated' END AS status, coalesce(added, 0) AS added, CASE WHEN ticker % 10 = 4 THEN 0 ELSE n - coalesce(added, 0) END AS dropped, coalesce(held, 0) + coalesce(added, 0) AS stored FROM f LEFT JOIN a USING (ticker) LEFT JOIN h USING (ticker)""")
@V.bars_once
def v15_caught_up(spark: SparkSession, d: str) -> DataFrame:
    """Two years fetched, of which some tickers come without prices; what passes is appended to the stored bars."""
    from tidemark.shared import checkpointed, shared_dir
    from tidemark.sources import lake

    store = f"{shared_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    lake.write_bars(V.bars(spark, d).where("date < '2000-01-01'"), store)
    fetched = faulty(spark, d).where("date >= '2000-01-01'").withColumn("close", F.when(F.col("ticker") % 10 != 4, F.col("close"))).drop("k")
    fetched = checkpointed(fetched)
    clean, report = Q.caught_up(fetched)
    lake.write_bars(clean, store)
    stored = spark.read.parquet(store).groupBy("ticker").agg(F.count("*").alias("stored"))
    return report.join(stored, "ticker", "left").na.fill(0, ["stored"])


@query(SQL["v08_report"])
def sk11_validation_reports(spark: SparkSession, d: str) -> DataFrame:
    """SK11: each ticker's report as a JSON line of the day's folder, read again."""
    from tidemark.shared import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}/day=2001-11-10"
    rows = v08_report(spark, d)
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)
