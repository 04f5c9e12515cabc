"""Round trips through the lake, and ticks to bars as a table and as a stream."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import six
from tidemark.plans import backtest, learning  # noqa: F401 (their SQL is read here)
from tidemark.plans.registry import SQL, query
from tidemark.plans.xsec import _PANEL, panel
from tidemark.shared import checkpointed, shared_dir
from tidemark.sources import lake
from tidemark.sources import views as V
from tidemark.streaming import regimes as G
from tidemark.streaming import source
from tidemark.streaming import ticks as T


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {V.BARS} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS bars, round(sum(CASE WHEN year(date) = 1998 THEN close * 2 ELSE close END), 4) AS closes FROM bars GROUP BY 1""")
def sk01_bars_by_year(spark: SparkSession, d: str) -> DataFrame:
    """SK01, SC03 and SC08: bars written by year, one year overwritten, read again."""
    path, bars = _path(spark, "bars"), V.bars(spark, d)
    lake.write_bars(bars, path)
    lake.write_bars(bars.where(F.year("date") == 1998).withColumn("close", F.col("close") * 2), path, "overwrite")
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("closes"))


@query(f"""WITH {V.BARS} SELECT ticker, date, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""")
def sc03_partitioned_range(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "bars")
    lake.write_bars(V.bars(spark, d), path)
    return lake.read_bars(spark, path, "1997-03-01", "1998-02-28", ["close"]).withColumn("close", six(F.col("close")))


@query(f"""WITH {_PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY mom DESC, ticker) AS rank FROM panel) SELECT ticker, as_of AS date, round(mom, 6) AS score, CAST(rank AS INTEGER) AS rank, sector FROM r WHERE as_of = (SELECT max(as_of) FROM r) AND rank <= 10""")
def sc09_latest_signals(spark: SparkSession, d: str) -> DataFrame:
    """SK03, SC09, X17 and S13: signals written with metadata as JSON, the last date's best read again."""
    path = _path(spark, "signals")
    lake.write_signals(_signals(spark, d), path)
    rows = lake.latest_signals(spark, path, "mom_v1", 10)
    return rows.select("ticker", F.col("date").cast("date").alias("date"), six(F.col("score")).alias("score"), "rank", F.get_json_object("metadata", "$.sector").alias("sector"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.xsec import ranked

    rows = ranked(panel(spark, d), ["as_of"], "mom")
    return rows.select("ticker", F.col("as_of").alias("date"), F.lit("mom_v1").alias("model_name"), F.col("mom").alias("score"), "rank", "sector")


@query(f"""WITH {_PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY mom DESC, ticker) AS rank FROM panel) SELECT as_of AS date, count(*) AS n, round(avg(mom), 6) AS mean, round(max(CASE WHEN rank = 1 THEN mom END), 6) AS best FROM r WHERE as_of BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1""")
def sc10_signal_history(spark: SparkSession, d: str) -> DataFrame:
    """SC10."""
    path = _path(spark, "signals")
    lake.write_signals(_signals(spark, d), path)
    rows = lake.signal_history(spark, path, "mom_v1", "1999-01-01", "1999-12-31")
    return rows.groupBy(F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"), six(F.avg("score")).alias("mean"), six(F.max(F.when(F.col("rank") == 1, F.col("score")))).alias("best"))


@query(f"""WITH {V.BARS} SELECT ticker, count(*) AS bars, round(sum(CASE WHEN date >= DATE '2001-01-01' THEN close + 1 ELSE close END), 4) AS closes FROM bars GROUP BY 1""")
def sk08_upsert(spark: SparkSession, d: str) -> DataFrame:
    """SK08, H02 and H04."""
    bars = V.bars(spark, d).select("ticker", "date", "close")
    new = bars.where("date >= '2001-01-01'").withColumn("close", F.col("close") + 1)
    return lake.upserted(bars, new, ["ticker", "date"]).groupBy("ticker").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("closes"))


@query("""SELECT n_name AS name, CAST(n_regionkey AS INTEGER) AS region FROM nation""")
def sk09_csv_and_json(spark: SparkSession, d: str) -> DataFrame:
    """SK09, SK10, SC15 and SC16: a table out as CSV and as JSON lines, in again with a declared schema."""
    rows = V.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    path = _path(spark, "nation")
    rows.write.option("header", "true").csv(f"{path}/csv")
    spark.read.schema(rows.schema).option("header", "true").csv(f"{path}/csv").write.json(f"{path}/json")
    return spark.read.schema(rows.schema).json(f"{path}/json")


@query("""SELECT r_regionkey AS version, substr(md5('{"kind":"momentum","r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}'), 1, 6) AS id FROM region""")
def sk06_experiment_ids(spark: SparkSession, d: str) -> DataFrame:
    """SK06 and S14."""
    config = V.table(spark, d, "region").select("r_regionkey", "r_name", F.lit("momentum").alias("kind"))
    return lake.experiment_id(config).select(F.col("r_regionkey").alias("version"), "id")


@query(None)
def sk12_file_digests(spark: SparkSession, d: str) -> DataFrame:
    """SK12."""
    return lake.file_digests(spark, f"{d}/nation.parquet")


_TB = """SELECT symbol, start, round(arg_min(price, k), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, k), 6) AS close, count(*) AS ticks FROM (
SELECT event_type AS symbol, date_trunc('hour', ts) AS start, value AS price, {'t': ts, 'e': event_id} AS k FROM events) GROUP BY 1, 2"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), *[six(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "ticks")


@query(_TB)
def st_hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(T.tumbling(V.ticks(spark, d)))


@query(_TB)
def st_streamed_bars(spark: SparkSession, d: str) -> DataFrame:
    """ST1: the same bars from a stream of the table's files, drained in complete mode."""
    schema = V.table(spark, d, "events").schema
    return _rounded(T.drained(T.tumbling(T.stream(spark, f"{d}/events.parquet*", schema))))


@query("""WITH s AS (SELECT event_type AS symbol, ts, value, event_id, unnest([0, 1, 2, 3]) AS back FROM events), w AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts) - back * INTERVAL 6 HOUR AS start, value FROM s)
SELECT symbol, start, round(max(value), 6) AS high, round(min(value), 6) AS low, count(*) AS ticks FROM w GROUP BY 1, 2""")
def st_sliding_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = _rounded(T.sliding(V.ticks(spark, d), "24 hours", "6 hours"))
    return rows.select("symbol", "start", "high", "low", "ticks")


@query("""WITH g AS (SELECT event_type AS symbol, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM g) SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS ends, count(*) AS ticks FROM i GROUP BY symbol, k""")
def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.sessions(V.ticks(spark, d), "20 minutes").select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("ends").cast("timestamp_ntz").alias("ends"), "ticks")


@query("""WITH s AS (SELECT * FROM (VALUES ('click', 'a'), ('click', 'b'), ('purchase', 'a')) t(symbol, client)) SELECT client, symbol, count(*) AS ticks FROM events JOIN s ON event_type = symbol GROUP BY 1, 2""")
def st_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """ST3: a tick reaches the clients that subscribe to its symbol, and no other."""
    wanted = spark.createDataFrame([("click", "a"), ("click", "b"), ("purchase", "a")], "symbol string, client string")
    return T.subscribed(V.ticks(spark, d), wanted).groupBy("client", "symbol").agg(F.count("*").alias("ticks"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.backtest import selected
    from tidemark.plans.backtest import scores

    return selected(scores(spark, d), "as_of", "score").select("ticker", F.col("as_of").alias("date"), F.lit("equal_v1").alias("model_name"), six(F.col("weight")).alias("weight"), "sector")


@query(f"SELECT ticker, weight, sector FROM ({SQL['b02_selection']}) WHERE as_of = (SELECT max(as_of) FROM ({SQL['b02_selection']}))")
def sc11_latest_targets(spark: SparkSession, d: str) -> DataFrame:
    """SK04 and SC11: target weights written by model and date, the last date's read again."""
    path = _path(spark, "targets")
    lake.write_targets(_targets(spark, d), path)
    return lake.latest_targets(spark, path, "equal_v1").select("ticker", "weight", "sector")


@query(f"SELECT as_of AS date, count(*) AS n, round(sum(weight), 4) AS weight FROM ({SQL['b02_selection']}) WHERE as_of BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1")
def sc12_target_history(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "targets")
    lake.write_targets(_targets(spark, d), path)
    rows = lake.signal_history(spark, path, "equal_v1", "1999-01-01", "1999-12-31")
    return rows.groupBy(F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"WITH {_PANEL} SELECT DISTINCT 'mom_v1' AS model_name, as_of AS date FROM panel")
def sc13_signal_dates(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "signals")
    lake.write_signals(_signals(spark, d), path)
    return lake.dates(spark, path)


@query(f"WITH {_PANEL} SELECT 'mom_v1' AS model_name, count(DISTINCT as_of) AS dates, count(*) AS n, min(as_of) AS first_date, max(as_of) AS last_date, true AS stored FROM panel HAVING count(*) > 0")
def sc25_store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """SC25; how many files and bytes a table takes depends on the run, so they are only held to be there."""
    path = _path(spark, "signals")
    lake.write_signals(_signals(spark, d), path)
    rows = lake.statistics(spark, path)
    return rows.select("model_name", "dates", "n", "first_date", "last_date", ((F.col("files") >= F.col("dates")) & (F.col("bytes") > 0)).alias("stored"))


@query(f"""WITH {_PANEL}, c AS (SELECT as_of AS snapshot_date, count(DISTINCT ticker) AS universe_size, sum(mom) AS mom FROM panel WHERE as_of IN (DATE '1998-12-31', DATE '1999-12-31') GROUP BY 1) SELECT snapshot_date, universe_size, 3 AS feature_count, round(mom, 6) AS mom FROM c""")
@V.bars_once
def sc14_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """SK05 and SC14: two dates' universe and features as snapshots, listed and read again."""
    from functools import reduce

    path, days = _path(spark, "snapshots"), ("1998-12-31", "1999-12-31")
    rows = checkpointed(panel(spark, d).where(F.col("as_of").isin(*[F.lit(day).cast("date") for day in days])))  # one panel for both dates
    for day in days:
        lake.write_snapshot(rows.where(F.col("as_of") == day).select("ticker", "mom", "vsm"), path, day, source="panel")
    read = [lake.read_snapshot(spark, path, day).agg(F.sum("mom").alias("mom")).withColumn("snapshot_date", F.lit(day).cast("date")) for day in days]
    return lake.snapshots(spark, path).join(reduce(DataFrame.union, read), "snapshot_date").where("universe_size > 0").select("snapshot_date", "universe_size", "feature_count", six(F.col("mom")).alias("mom"))


@query(f"""WITH {V.FUNDAMENTALS} SELECT CAST(year(period) AS INTEGER) AS year, count(*) AS n, round(sum(CASE WHEN year(period) = 1997 THEN revenue * 2 ELSE revenue END) / 1000, 2) AS revenue FROM fundamentals GROUP BY 1""")
def sk02_fundamentals_by_year(spark: SparkSession, d: str) -> DataFrame:
    """SK02: written by year, one year restated, read again."""
    path, rows = _path(spark, "fundamentals"), V.fundamentals(spark, d)
    lake.write_fundamentals(rows, path)
    lake.write_fundamentals(rows.where(F.year("period") == 1997).withColumn("revenue", F.col("revenue") * 2), path, "overwrite")
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("revenue") / 1000, 2).alias("revenue"))


@query("""SELECT 'suppliers' AS name, '1' AS version, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier UNION ALL SELECT 'suppliers', '2', count(*), round(sum(s_acctbal), 2) FROM supplier WHERE s_acctbal > 0""")
def sk07_dataset_versions(spark: SparkSession, d: str) -> DataFrame:
    """SK07: two versions of a dataset, found by the catalogue and read by version."""
    path, rows = _path(spark, "datasets"), V.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    lake.write_version(rows, path, "suppliers", "1")
    lake.write_version(rows.where("s_acctbal > 0"), path, "suppliers", "2")
    sums = spark.read.parquet(f"{path}/suppliers").groupBy(F.col("version").cast("string").alias("version")).agg(F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return lake.catalogue(spark, path).join(F.broadcast(sums), "version").select("name", "version", "n", "balance")


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS version, 'ranker' AS type, '{"region":' || n_regionkey || '}' AS parameters FROM nation WHERE n_regionkey < 3""")
def sk13_model_registry(spark: SparkSession, d: str) -> DataFrame:
    """SK13: models registered twice or once, the last version of one type."""
    path = _path(spark, "models")
    kind = F.when(F.col("n_regionkey") < 3, "ranker").otherwise("optimiser")
    parameters = F.to_json(F.struct(F.col("n_regionkey").alias("region")))
    rows = V.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("version"), kind.alias("type"), parameters.alias("parameters"), "n_nationkey")
    lake.register_model(rows.drop("n_nationkey"), path)
    lake.register_model(rows.where("n_nationkey % 2 = 0").withColumn("version", F.lit(2)).drop("n_nationkey"), path)
    return lake.models(spark, path, "ranker")


@query(f"""WITH {V.BARS} SELECT 'bars' AS name, count(*) AS here, count(*) AS there, true AS same FROM bars UNION ALL SELECT 'nation', count(*), count(*), true FROM nation""")
def h06_moved_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tables moved into the lake hold as many rows as they came with."""
    path, bars, nation = _path(spark, "moved"), V.bars(spark, d), V.table(spark, d, "nation")
    lake.write_bars(bars, f"{path}/bars")
    nation.write.parquet(f"{path}/nation")
    both = [("bars", bars), ("nation", nation)]
    counts = [b.agg(F.count("*").alias("here")).join(spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("there"))).select(F.lit(n).alias("name"), "here", "there") for n, b in both]
    return counts[0].union(counts[1]).withColumn("same", F.col("here") == F.col("there"))


@query(f"""WITH {_PANEL} SELECT name, count(*) AS n, round(sum(mom), 5) AS score FROM panel JOIN (SELECT s_suppkey AS ticker, s_name AS name FROM supplier) USING (ticker) GROUP BY 1""")
def h07_migrated_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals by name instead of number, joined to the securities and written by model and date."""
    path = _path(spark, "signals")
    named = _signals(spark, d).join(V.security(spark, d).select("ticker", "name"), "ticker")
    lake.write_signals(named, path)
    rows = spark.read.parquet(path).select(F.get_json_object("metadata", "$.name").alias("name"), "score")
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("score"), 5).alias("score"))


@query("""SELECT event_type AS symbol, count(*) AS ticks, round(max(value), 6) AS high, 1 AS failures FROM events GROUP BY 1""")
def st_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """ST2: a stream's epochs to a callback that counts and to one that fails, which is noted and stops nothing."""
    path = _path(spark, "fan")

    def count(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("symbol").agg(F.count("*").alias("ticks"), F.max("price").alias("high")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    def fail(batch: DataFrame, epoch: int) -> None:
        raise ValueError("no such client")

    ticks = T.stream(spark, f"{d}/events.parquet*", V.table(spark, d, "events").schema)
    failed = T.fanned_out(ticks, {"fail": fail, "count": count})
    rows = spark.read.schema("symbol string, ticks long, high double").parquet(path).groupBy("symbol").agg(F.sum("ticks").alias("ticks"), F.max("high").alias("high"))
    return rows.select("symbol", "ticks", six(F.col("high")).alias("high"), F.lit(len({name for name, _, _ in failed})).alias("failures"))


def _regimes(spark: SparkSession, d: str, most: float) -> DataFrame:
    """Returns by date in two halves: the stream drains the first and stops; started again from its checkpoint it takes the second."""
    path = _path(spark, "regimes")
    rows = V.returns(spark, d).where("ret IS NOT NULL").select("ticker", "date", F.col("ret").alias("value"), F.lit(False).alias("reset"))
    rows.write.parquet(f"{path}/all")
    rows = spark.read.parquet(f"{path}/all")
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    middle = first + (last - first) / 2 if first else None
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/slices/*")
    for k, part in enumerate((rows.where(F.col("date") <= F.lit(middle)), rows.where(F.col("date") > F.lit(middle)))):
        part.write.parquet(f"{path}/slices/k={k}")
        G.kept(G.learnt(stream, most=most), f"{path}/states", f"{path}/checkpoint")
    states = spark.read.option("basePath", f"{path}/states").schema(f"{G.OUT.format(ticker=rows.schema['ticker'].dataType.simpleString())}, epoch long").parquet(f"{path}/states")
    return states.groupBy("ticker").agg(*[F.max_by(c, "epoch").alias(c) for c in ("n", "bull", "mean_bull", "mean_bear", "decay", "drifts")])


@query(SQL["x19_online_regime"])
def st_streamed_regimes(spark: SparkSession, d: str) -> DataFrame:
    """ST6, X19 and X21: the batch fold's rows from a stream that was stopped and started again."""
    return _regimes(spark, d, float("inf")).select("ticker", *[six(F.col(c)).alias(c) for c in ("bull", "mean_bull", "mean_bear")], six(0.5 + 0.5 * F.col("bull")).alias("multiplier"))


@query(None)
def st_adaptive_regimes(spark: SparkSession, d: str) -> DataFrame:
    """ST6 and X20: drifts of the errors make learning faster for 20 steps."""
    return _regimes(spark, d, 0.1).select("ticker", "n", *[six(F.col(c)).alias(c) for c in ("bull", "mean_bull", "mean_bear", "decay")], "drifts")


@query(None)
def st_tick_source(spark: SparkSession, d: str) -> DataFrame:
    """ST1: a tick source that walks from each ticker's last close, streamed in five batches to five-minute bars."""
    last = V.bars(spark, d).groupBy("ticker").agg(F.max_by("close", "date").alias("close")).orderBy(F.desc("close"), "ticker").limit(20)
    prices = json.dumps({str(r["ticker"]): r["close"] for r in last.collect()})
    spark.dataSource.register(source.TickSource)
    ticks = spark.readStream.format("tidemark_ticks").options(prices=prices, rows="300", total="1500").load()
    path = _path(spark, "walks")
    run = ticks.writeStream.format("parquet").option("path", f"{path}/ticks").option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    rows = spark.read.schema(source.SCHEMA).parquet(f"{path}/ticks")
    bars = T.tumbling(rows.withColumn("event_id", F.col("step")), "5 minutes").join(rows.groupBy("symbol", F.window("ts", "5 minutes")["start"].alias("start")).agg(F.sum("volume").alias("volume")), ["symbol", "start"])
    return bars.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), *[six(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "ticks", "volume")
