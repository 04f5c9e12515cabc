"""The shared folder: where long lineages are cut so that lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the cluster names none, a folder under the warehouse is taken; in local
    mode, where driver and executors are one process, a temporary one.
    """
    held = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if held is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        held = tempfile.mkdtemp(prefix="tidemark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(held)
    return held


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: computed once, read again by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """``df`` as a table of the shared folder in buckets sorted by ``by``: joins on it don't shuffle it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    df.write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._tidemark_path, out._tidemark_table = path, table
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table made by :func:`written` or :func:`bucketed` that nothing reads any more."""
    spark = df.sparkSession
    if table := getattr(df, "_tidemark_table", None):
        spark.sql(f"DROP TABLE {table}")
    removed(spark, df._tidemark_path)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether there is a folder, wherever Spark can read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, in files that all executors share and Spark cleans up."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def laid_out(df: DataFrame) -> DataFrame:
    """``df`` checkpointed with how its rows lie: by an adaptive plan the table would not know its partitioning and order, and each window would shuffle and sort it."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


#: Rows of a few numbers each that may be broadcast: some 10 MB at most.
MOST_BROADCAST = 250_000


def counted(df: DataFrame, *more: Column) -> tuple[DataFrame, tuple]:
    """``df`` checkpointed; its rows and what ``more`` sums up, taken as it is written instead of by a query more."""
    seen = Observation()
    out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n0"), *[c.alias(f"n{k}") for k, c in enumerate(more, 1)]))
    return out, tuple(seen.get[f"n{k}"] for k in range(len(more) + 1))


def fitting(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, a written or checkpointed table of short rows, to be broadcast if it has ``most`` rows at most; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def fitted(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` checkpointed, to be joined as :func:`fitting` says."""
    out, (rows,) = counted(df)
    return F.broadcast(out) if rows <= most else out
