"""The lake: partitioned tables of bars, signals, targets, snapshots and experiments, written and read by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.shared import checkpointed, exists

#: Columns that a signal must have.
SIGNAL = ("ticker", "date", "model_name", "score", "rank")


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Bars by year; ``overwrite`` replaces the years that are written and no other."""
    rows = bars.withColumn("year", F.year("date")).repartition("year", F.pmod(F.xxhash64("ticker"), F.lit(8)))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def read_bars(spark: SparkSession, path: str, start: str, end: str, fields: list[str] | None = None) -> DataFrame:
    """Bars between two dates; the years are named too, so that other partitions aren't listed."""
    rows = spark.read.parquet(path).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("year").between(int(start[:4]), int(end[:4])))
    return rows.select("ticker", "date", *fields) if fields else rows.drop("year")


def write_signals(signals: DataFrame, path: str, mode: str = "append") -> None:
    """Signals by model and date; columns beyond SIGNAL go to ``metadata`` as JSON."""
    if gone := [c for c in SIGNAL if c not in signals.columns]:
        raise ValueError(f"signals lack {', '.join(gone)}")
    rest = [c for c in signals.columns if c not in SIGNAL]
    rows = signals.select(*SIGNAL, (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model_name", "date").parquet(path)


def latest_signals(spark: SparkSession, path: str, model: str, n: int) -> DataFrame:
    """The n best of a model's last date; its partitions are pruned by model first."""
    rows = spark.read.parquet(path).where(F.col("model_name") == model)
    last = rows.agg(F.max("date").alias("date"))
    return rows.join(F.broadcast(last), "date").orderBy("rank").limit(n)


def signal_history(spark: SparkSession, path: str, model: str, start: str, end: str) -> DataFrame:
    """A model's signals between two dates, by partitions."""
    return spark.read.parquet(path).where((F.col("model_name") == model) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with new ones put over them by key."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(*keys, "r.*")


def experiment_id(config: DataFrame) -> DataFrame:
    """config with id: the first six digits of its canonical JSON's md5."""
    return config.withColumn("id", F.substring(F.md5(F.to_json(F.struct(*sorted(config.columns)))), 1, 6))


RUN = "run_id string, created string, config string, config_hash string, metrics string, metadata string"


def save_experiments(runs: DataFrame, path: str, on: str, **tables: DataFrame) -> None:
    """Add experiments of the day ``on``: their configurations, metrics and metadata (JSON), and tables that have the runs' key ``run``.

    A run's id is the day and the first six digits of the md5 of its configuration. Where that is taken, ``_1``
    is added, then ``_2`` to that, and so on, also within ``runs``. Each table is written once for all runs, by run_id.
    """
    spark = runs.sparkSession
    base = F.concat(F.lit(f"{on}_"), F.substring("config_hash", 1, 6))
    rows = runs.withColumn("config_hash", F.md5("config")).withColumn("base", base)
    taken = _runs(spark, path).select(F.regexp_extract("run_id", "^([0-9-]+_[0-9a-f]{6})", 1).alias("base")).groupBy("base").agg(F.count("*").alias("taken"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("run")) - 1 + F.coalesce("taken", F.lit(0))
    rows = rows.join(taken, "base", "left").withColumn("k", place)
    suffix = F.when(F.col("k") > 0, F.concat(F.lit("_"), F.array_join(F.sequence(F.lit(1), F.col("k")), "_"))).otherwise("")
    given = [F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in ("metrics", "metadata")]
    # written first: what follows must not number the runs again
    named = checkpointed(rows.select("run", F.concat("base", suffix).alias("run_id"), F.lit(on).alias("created"), "config", "config_hash", *given))
    for name, table in tables.items():
        table.join(named.select("run", "run_id"), "run").drop("run").repartition("run_id").write.mode("append").partitionBy("run_id").parquet(f"{path.rstrip('/')}/{name}")
    named.drop("run").write.mode("append").json(f"{path.rstrip('/')}/runs")  # last: only whole experiments are listed


def _runs(spark: SparkSession, path: str) -> DataFrame:
    at = f"{path.rstrip('/')}/runs"
    return spark.read.schema(RUN).json(at) if exists(spark, at) else spark.createDataFrame([], RUN)


def experiments(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The n newest experiments."""
    return _runs(spark, path).orderBy(F.desc("run_id")).limit(n)


def experiment_rows(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of the experiments, of one run (by its partition) or of all."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{path.rstrip('/')}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """bytes and sha256 of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: Columns that a target must have.
TARGET = ("ticker", "date", "model_name", "weight")


def write_targets(targets: DataFrame, path: str, mode: str = "append") -> None:
    """Target weights by model and date."""
    if gone := [c for c in TARGET if c not in targets.columns]:
        raise ValueError(f"targets lack {', '.join(gone)}")
    targets.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model_name", "date").parquet(path)


def latest_targets(spark: SparkSession, path: str, model: str) -> DataFrame:
    """A model's targets of its last date, heaviest first."""
    rows = spark.read.parquet(path).where(F.col("model_name") == model)
    return rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date").orderBy(F.desc("weight"), "ticker")


def dates(spark: SparkSession, path: str) -> DataFrame:
    """model_name, date: what a table of signals or targets holds, from its partitions, newest first."""
    return spark.read.parquet(path).select("model_name", F.col("date").cast("date").alias("date")).distinct().orderBy("model_name", F.desc("date"))


def write_fundamentals(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Fundamentals by year of their period; ``overwrite`` replaces the years that are written."""
    rows = rows.withColumn("year", F.year("period"))
    rows.repartition("year", F.pmod(F.xxhash64("ticker"), F.lit(8))).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_snapshot(features: DataFrame, path: str, date: str, **metadata: str) -> None:
    """The universe and features of a date, with what is known about them as one JSON line beside."""
    spark, at = features.sparkSession, f"{path.rstrip('/')}/{date}"
    features.write.mode("overwrite").parquet(f"{at}/features")
    held = spark.read.schema(features.schema).parquet(f"{at}/features")
    held.select("ticker").distinct().write.mode("overwrite").parquet(f"{at}/universe")
    size = held.agg(F.count_distinct("ticker").alias("universe_size"))
    about = size.select(F.lit(date).alias("snapshot_date"), "universe_size", F.lit(len(features.columns)).alias("feature_count"), *[F.lit(v).alias(k) for k, v in metadata.items()])
    about.write.mode("overwrite").json(f"{at}/metadata")


def read_snapshot(spark: SparkSession, path: str, date: str) -> DataFrame:
    """The features of a snapshot."""
    return spark.read.parquet(f"{path.rstrip('/')}/{date}/features")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A row a snapshot, newest first."""
    known = "snapshot_date date, universe_size long, feature_count int"
    return spark.read.schema(known).json(f"{path.rstrip('/')}/*/metadata").orderBy(F.desc("snapshot_date"))


def write_version(rows: DataFrame, path: str, name: str, version: str) -> None:
    """A dataset's version as a table of its own, and a line about it in the catalogue; a version is never written again."""
    at = f"{path.rstrip('/')}/{name}/version={version}"
    rows.write.mode("errorifexists").parquet(at)
    held = rows.sparkSession.read.schema(rows.schema).parquet(at)
    entry = held.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "n", F.lit(at).alias("path"))
    entry.write.mode("append").json(f"{path.rstrip('/')}/_catalogue/{name}")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """name, version, n, path of each version that was written."""
    return spark.read.schema("name string, version string, n long, path string").json(f"{path.rstrip('/')}/_catalogue/*")


def register_model(models: DataFrame, path: str) -> None:
    """Add models (name, version, type, parameters) to the registry's lines."""
    models.write.mode("append").json(path)


def models(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Each model's last version, of one type or of all."""
    rows = spark.read.schema("name string, version int, type string, parameters string").json(path)
    if kind:
        rows = rows.where(F.col("type") == kind)
    return rows.groupBy("name").agg(F.max_by(F.struct("version", "type", "parameters"), "version").alias("r")).select("name", "r.*")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """model_name, dates, n, first_date, last_date, files, bytes of a table of signals or targets."""
    rows = spark.read.parquet(path)
    day = F.col("date").cast("date")
    held = rows.groupBy("model_name").agg(F.count_distinct(day).alias("dates"), F.count("*").alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    model = F.regexp_extract("path", "model_name=([^/]+)", 1)
    sizes = files.select(model.alias("model_name"), "length").groupBy("model_name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return held.join(sizes, "model_name", "left")
