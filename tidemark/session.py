"""The session this library is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; ``conf`` overrides, with ``__`` for dots."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    held = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in held.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
