"""Ticks to bars: the same aggregation over a table and over a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import shared_dir


def _bars(grouped) -> DataFrame:
    key = F.struct("ts", "event_id")
    return grouped.agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("*").alias("ticks")
    )


def tumbling(ticks: DataFrame, every: str = "1 hour") -> DataFrame:
    """symbol, start, open, high, low, close, ticks of windows side by side."""
    return _bars(ticks.groupBy("symbol", F.window("ts", every).alias("w"))).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def sliding(ticks: DataFrame, size: str, step: str) -> DataFrame:
    """The same over windows that overlap."""
    return _bars(ticks.groupBy("symbol", F.window("ts", size, step).alias("w"))).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def sessions(ticks: DataFrame, gap: str) -> DataFrame:
    """symbol, start, ends, ticks of runs of ticks with less than ``gap`` between them."""
    w = ticks.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"))
    return w.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("ends"), "ticks")


def stream(spark: SparkSession, path: str, schema, watermark: str = "1 day") -> DataFrame:
    """Ticks as a stream of a folder's files; the event time is cast, since watermarks need an instant."""
    rows = spark.readStream.schema(schema).parquet(path)
    ticks = rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")
    return ticks.withWatermark("ts", watermark)


def subscribed(ticks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Ticks of the symbols that someone subscribes to (symbol, client), once for each client.

    Clients are as many as there are: Spark broadcasts them where their size allows.
    """
    return ticks.join(subscriptions, "symbol")


def drained(out: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """What a stream gives for all input that is there now, as a table of the shared folder.

    Each epoch replaces the table in complete mode and adds to it in append mode.
    """
    spark = out.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        path = f"{base}/rows" if mode == "complete" else f"{base}/rows/epoch={epoch}"
        batch.write.mode("overwrite").parquet(path)

    query = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def fanned_out(out: DataFrame, callbacks: dict[str, Callable[[DataFrame, int], None]], mode: str = "append", checkpoint: str | None = None) -> list[tuple[str, int, str]]:
    """Every epoch of a stream to every callback, for all input that is there now; and what failed, as (callback, epoch, error).

    A callback that fails stops neither the others nor the stream. An epoch may be sent again after
    a restart, so callbacks should write by epoch.
    """
    failed: list[tuple[str, int, str]] = []

    def send(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        for name, call in callbacks.items():
            try:
                call(held, epoch)
            except Exception as e:  # noqa: BLE001 (callbacks are the user's)
                failed.append((name, epoch, str(e)))
        held.unpersist()

    at = checkpoint or f"{shared_dir(out.sparkSession).rstrip('/')}/fan-{uuid.uuid4().hex}"
    out.writeStream.outputMode(mode).foreachBatch(send).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return failed
