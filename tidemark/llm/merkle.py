"""Merkle manifest of a dataset: one tree of rows a source, one tree of the sources' roots.

Rows become digests where they lie; only digests are shuffled. They are dealt out by
ranges of (source, doc_id), so a source of any size spreads over tasks, and numbered
from the ranges' counts. 729 consecutive leaves are one ordered array, and
higher-order functions (``sequence``, ``transform``, ``slice``, ``aggregate``) collapse its
levels, every three nodes into one. The arrays' roots are the leaves of the next round
until each source has one; the sources' roots are numbered and collapsed likewise.
Siblings come down the same way: an array's own levels give the lower part of a proof,
the round above gives the upper part. No Python worker takes part.

Nulls: a null column of a row is ``-`` in its leaf; a null source is a source of its
own and comes first; rows of a null doc_id come first in their source and are not
tampered with. Rows of one source and doc_id ascend by leaf; rows equal in all five
columns each keep a leaf. An empty text is a value of length 0. An empty table has no
rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

#: Nodes of a run, levels that one array collapses, and leaves of an array.
RUN = 3
LEVELS = 6
SIZE = RUN**LEVELS
#: Paths, of some 2 KB each, that may be broadcast.
MOST_PATHS = 4_000
SCHEMA = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns' concatenation."""
    return F.sha2(F.concat(*columns), 256)


def framed(column: Column) -> Column:
    """A value as a leaf takes it: its length in bytes and itself, or ``-``."""
    told = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id and leaf of each row, and the leaf of its tampered text where that differs."""
    leaf = digest(*[framed(F.col(c)) for c in COLUMNS])
    cut = digest(*[framed(F.col(c)) for c in COLUMNS[:-1]], framed(F.translate("text", "\n", "")))
    tampered = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0) & F.contains("text", F.lit("\n"))
    return docs.select("source", "doc_id", leaf.alias("leaf"), F.when(tampered, cut).alias("changed"))


def _sent(table: DataFrame, name: str, rows: int) -> DataFrame:
    """``table``, written short rows, to be broadcast if it has ``rows`` at most and its names ``name`` take 4 MB at most; else joined by shuffle."""
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(name).cast("string"))), F.lit(0))).first()
    return F.broadcast(table) if n <= rows and size <= 4 << 20 else table


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``idx``, the place in their ``tree`` by ``order`` from 0, and ``n``, the tree's size; and the largest size.

    Ranges are sorted and written with a running number; the first of it in each
    range and tree, with the counts of the ranges before, gives the place. Equal rows
    are told apart by where they were read.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "merkle-rows")
    tree, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("tree", "_range").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col("tree").alias("_tree"), F.col("_range").alias("_part"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    starts = written(starts, "merkle-starts")
    out = dealt.join(_sent(starts, "_tree", 250_000), (F.col("_range") == F.col("_part")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return out.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_tree", "_part", "_shift"), starts.agg(F.max("n")).first()[0] or 0


def _collapsed(nodes: Column) -> Column:
    """The level above ``nodes``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) + RUN - 1) / RUN).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * RUN + 1, F.lit(RUN)), ""), 256))


def blocks(nodes: DataFrame) -> DataFrame:
    """Arrays of up to SIZE consecutive ``nodes`` (tree, idx, n, node, held) with their levels and their root, written.

    An array of a tree that has more than one collapses all LEVELS, else as many as leave one node.
    """
    depth = reduce(lambda d, k: F.when(F.col("n") > RUN**k, k + 1).otherwise(d), range(LEVELS), F.lit(0))
    members = F.array_sort(F.collect_list(F.struct("idx", "node", "held")))
    first = F.transform("members", lambda m: m["node"])
    levels = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), F.col("depth")), F.array(first), lambda held, _: F.concat(held, F.array(_collapsed(F.element_at(held, -1)))))
    rows = nodes.groupBy("tree", "n", F.floor(F.col("idx") / SIZE).alias("block")).agg(members.alias("members")).withColumn("depth", depth.cast("int"))
    return written(rows.withColumn("levels", levels), "merkle-blocks")


def _roots(held: DataFrame) -> DataFrame:
    """The arrays' roots as nodes of the next round."""
    return held.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / SIZE).alias("n"), F.element_at("levels", -1)[0].alias("node"), F.lit(None).cast("string").alias("held"))


def _own_path() -> Column:
    """Of each member of an array the siblings left and right of it, level by level within the array."""
    width = F.array(*[F.lit(RUN**k) for k in range(LEVELS + 1)])

    def siblings(place: Column, level: Column) -> Column:
        start = F.floor(place / width[level + 1]).cast("int") * RUN
        mine = F.floor(place / width[level]).cast("int") - start
        nodes = F.element_at("levels", level + 1)
        return F.struct(F.array_join(F.slice(nodes, start + 1, mine), "").alias("left"), F.array_join(F.slice(nodes, start + mine + 2, F.lit(RUN - 1) - mine), "").alias("right"))

    def path(place: Column) -> Column:
        return F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), F.col("depth")), lambda level: siblings(place, level))

    return F.transform("members", lambda m, place: F.struct(m["idx"].alias("idx"), m["node"].alias("node"), m["held"].alias("held"), path(place).alias("path")))


def with_paths(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """tree, top, apex, idx, node, held and path of each of ``nodes``, whose largest tree has ``most``.

    ``path`` has the siblings from the node up to its tree's root ``top``. ``crown`` takes
    each tree's (tree, top) once and gives (tree, path, apex) from there on to the root
    of all; without it the tree's own root is the ``apex``.
    """
    held = blocks(nodes)
    if most > SIZE:
        up = with_paths(_roots(held), -(-most // SIZE), crown)
        up = written(up.select(F.col("tree").alias("_tree"), F.col("idx").alias("_block"), F.col("path").alias("_path"), "top", "apex"), "merkle-paths")
        wide = held.join(_sent(up, "_tree", MOST_PATHS), F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    elif crown is not None:  # each tree has one array
        wide = held.withColumn("top", F.element_at("levels", -1)[0])
        up = written(crown(wide.select("tree", "top")).select(F.col("tree").alias("_tree"), F.col("path").alias("_path"), "apex"), "merkle-paths")
        wide = wide.join(_sent(up, "_tree", MOST_PATHS), F.col("tree").eqNullSafe(F.col("_tree")))
    else:
        top = F.element_at("levels", -1)[0]
        wide = held.withColumns({"top": top, "apex": top, "_path": F.array().cast("array<struct<left:string,right:string>>")})
    rows = wide.select("tree", "top", "apex", "_path", F.inline(_own_path()))
    return rows.withColumn("path", F.concat("path", "_path")).drop("_path")


def _crown(tops: DataFrame) -> DataFrame:
    """Of each source's root the siblings up to the root of all."""
    nodes, most = numbered(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("held"), F.col("top").alias("node")), "held")
    return with_paths(nodes, most).select(F.col("held").alias("tree"), "path", "apex")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``, of which some are tampered with."""
    rows = leaves(docs).select(F.col("source").alias("tree"), "doc_id", F.col("leaf").alias("node"), F.struct("doc_id", "changed").alias("held"))
    nodes, most = numbered(rows, "doc_id", "node")
    if not most:
        return docs.sparkSession.createDataFrame([], SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("held.changed", "node"), lambda node, p: digest(p["left"], node, p["right"]))
    out = with_paths(nodes.drop("doc_id"), most, _crown)
    out = out.select("held.doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), F.col("apex").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
