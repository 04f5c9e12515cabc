"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table of the shared folder, bucketed and sorted by digest, to be opened again by
its name. New documents are digested, grouped by digest (with partial aggregation, so a
group of copies of any size reaches its task as a few partial rows) and anti-joined against the
index by merging the sorted buckets; what is new is appended with the doc_id that stays,
what is known adds its number of rows. A table is taken in batches from large to small
doc_ids, so that of equal texts the first one met has the largest.
Rows learn their group by a join on the digest; the few groups that hold more than ``HOT_SHARE`` of
all rows (fewer than ``1 / HOT_SHARE`` of them, whatever the data) are broadcast and their rows keep
out of the shuffled join, so no task receives a hot group.

Nulls: a null text equals an empty one; a null doc_id never stays if its group
has another, and keep_id is null where all are null. Repeated rows with the same
doc_id and text are copies: the doc_id stays, so each of its rows is ``kept``.
An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.shared import checkpointed, dropped, fitting, removed, shared_dir, written

HOT_SHARE = 0.001
BATCHES = 3


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each whole text as 32 bytes."""
    return docs.select("doc_id", _digest().alias("digest"))


class DigestIndex:
    """Digests seen so far, the doc_id that stays and the rows met, as a bucketed table that its name opens again.

    A new table has as many buckets as the session's shuffles have partitions, so that grouped digests are written as they lie.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        held = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first() if spark.catalog.tableExists(self.table) else None
        self.buckets = int(held.data_type) if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(self) -> DataFrame:
        """digest, keep_id, n and first: a row when a batch brings a new digest, one when it brings copies of a known one."""
        return self.spark.table(self.table)

    def groups(self) -> DataFrame:
        """digest, keep_id and group_size; the buckets are summed as they lie."""
        return self.rows().groupBy("digest").agg(F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"), F.sum("n").alias("group_size"))

    def add(self, docs: DataFrame) -> None:
        """Append what the index doesn't hold of ``docs`` (doc_id, text); of equal new texts the largest doc_id stays.

        A text the index already holds keeps its first verdict: batches published earlier aren't taken back.
        """
        self._append(digests(docs))

    def _append(self, rows: DataFrame) -> None:
        new = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        if self.spark.catalog.tableExists(self.table):
            known = self.rows().where("first").select("digest")
            new = checkpointed(new)
            again = new.join(known.hint("merge"), "digest", "left_semi").select("digest", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("keep_id"), "n", F.lit(False).alias("first"))
            new = new.join(known.hint("merge"), "digest", "left_anti").withColumn("first", F.lit(True)).union(again)
        else:
            new = new.withColumn("first", F.lit(True))
        path = f"{shared_dir(self.spark).rstrip('/')}/{self.table}"
        new.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(self.table)

    def add_in_batches(self, rows: DataFrame, batches: int = BATCHES) -> None:
        """Append written digests (doc_id, digest), those of the largest doc_ids first, so that the largest stays."""
        ends: list = []
        if isinstance(rows.schema["doc_id"].dataType, NumericType):
            shares = [k / batches for k in range(1, batches)]
            ends = sorted(set(rows.agg(F.percentile_approx("doc_id", shares)).first()[0] or []), reverse=True)
        doc_id = F.col("doc_id")
        for high, low in zip([None, *ends], [*ends, None], strict=True):
            below = F.lit(True) if high is None else F.coalesce(doc_id <= high, F.lit(True))  # null doc_ids come last
            above = F.lit(True) if low is None else F.coalesce(doc_id > low, F.lit(False))
            self._append(rows.where(below & above))

    def judged(self, rows: DataFrame) -> DataFrame:
        """digest, keep_id and group_size beside the doc_id of each row of written digests that were added."""
        groups = checkpointed(self.groups())
        total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        hot = groups.where(F.col("group_size") > max(1, int(HOT_SHARE * total)))
        held = [F.col(c).alias(f"hot_{c}") for c in ("digest", "keep_id", "group_size")]
        rows = rows.join(F.broadcast(hot.select(*held)), F.col("digest") == F.col("hot_digest"), "left")
        # rows of hot groups join nothing more: a key of their own deals them out evenly
        key = F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.encode(F.concat_ws(":", F.lit("hot"), F.xxhash64("doc_id")), "utf-8"))
        index = groups.select(F.col("digest").alias("key"), F.col("keep_id").alias("cold_keep_id"), F.col("group_size").alias("cold_size"))
        return rows.withColumn("key", key).join(index, "key", "left").select(
            "doc_id", "digest", F.when(F.col("hot_digest").isNull(), F.col("cold_keep_id")).otherwise(F.col("hot_keep_id")).alias("keep_id"),
            F.when(F.col("hot_digest").isNull(), F.col("cold_size")).otherwise(F.col("hot_group_size")).alias("group_size"),
        )

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        removed(self.spark, f"{shared_dir(self.spark).rstrip('/')}/{self.table}")


def deduplicated(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``, added to ``index``.

    Without an index a new one is made and removed in the end.
    """
    own = index or DigestIndex(docs.sparkSession)
    rows = written(digests(docs), "digests")
    own.add_in_batches(rows)
    out = own.judged(rows).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
    if index is None:
        own.drop()  # judged has what it needs of it
    return out


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts.

    Only the groups of two rows or more are looked up: they are broadcast where they are few, and
    joined by shuffle otherwise. Of rows repeated under the doc_id that stays any one stays.
    """
    index = DigestIndex(docs.sparkSession)
    rows = written(digests(docs), "digests")
    index.add_in_batches(rows)
    groups = fitting(checkpointed(index.groups().where("group_size > 1").select(F.col("digest").alias("of"), "keep_id")))
    index.drop()
    same = rows.join(groups, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = checkpointed(same.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select(F.col("digest").alias("twice")))
    dropped(rows)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", _digest().alias("digest"))
    stay = held.join(groups, F.col("digest") == F.col("of"), "left").where(F.col("of").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if again.isEmpty():
        return stay.select("row.*")
    stay = stay.join(fitting(again), F.col("digest") == F.col("twice"), "left")
    one = stay.where(F.col("twice").isNotNull()).groupBy("twice").agg(F.first("row").alias("row"))
    return stay.where(F.col("twice").isNull()).select("row.*").union(one.select("row.*"))
