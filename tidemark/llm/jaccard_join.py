"""N-gram Jaccard join: exact links between texts as a join in the metric space of word-shingle sets.

A text is its set of shingles, known by 51-bit hashes under a global order: rare shingles
first, of equally rare ones those with the rarest words (counts of shingles and of words over
all texts are held by class in tables of fixed size; the order affects speed alone). Texts with
equal sets are one class, so copies never meet again. r is the greatest distance of linked sets.

* Regions. Most sets are at distance 1 from each other, where no pivot tells them apart. A set
  within r of one with n shingles lacks at most ``n - ceil((1 - r) n)`` of them, so two such
  sets have j of the first ``n - ceil((1 - r) n) + j`` of each in common: their windows. How many
  classes show a shingle is counted exactly, and each class gives up the most frequent of its window,
  two fewer than any two such windows share: the rarest of what they share stays in both. So texts that have
  shingles of their own leave the join here, however coarse the tables are for the corpus. Sets that show
  the same shingle are a region; sets that share none are over r apart. Regions of one class
  end here, those of ``SMALL`` classes at most are joined pair by pair.
* Pivots and Voronoi cells. In a larger region sets are drawn as pivots: one (the set whose
  rarest shingle is the most frequent: an original has no shingles of its own, its edited copies
  have), and up to three more of those over 2r from the first. Each set of the region is measured
  against all its pivots. The nearest pivot's cell is its home, unless that is over 2r away. By the
  triangle inequality a set within r of one at home in a cell is at most 2r farther from that cell's pivot
  than from its own, and at most 3r away: such boundary sets are replicated to the cell. So of
  two sets within r one is at home in a cell that holds both, or neither is near a pivot.
  Sets within r of the same pivot are linked through it and need not meet.
* Recursion. In a cell a set is known by its difference from the pivot, and the differences are
  sets again: those that share one of their rarest elements, as many as the distances from the
  pivot leave open, are the regions of the next level. Sets far from all pivots of a first region
  share a second shingle of those they show if they are within r: that cuts it into regions of the
  next level. Those of ``LARGE`` sets at most are joined pair by pair, larger ones have pivots of their own.
  After ``DEPTH`` levels what is left is compared pair by pair.

Nothing is dropped or capped, so components are exact (up to hash collisions of
about n^2 / 2^52 within a text). Groups of near copies are measured against a few
pivots rather than each other.

Nulls: a null or empty text has no shingles and links with nothing; a null doc_id
takes part and is never a component's id unless all are null. Repeated rows are
copies. Texts shorter than a shingle are one shingle. An empty table gives no
rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.words import Words, each, joined, mixed, slices, texts, words
from tidemark.shared import bucketed, checkpointed, counted, dropped, fitted, fitting, written

#: Buckets of the tables of words and of shingles (2 and 8 MB); the most classes of a region without pivots on the first
#: level and on others, pivots of a larger one, levels; buckets of the table of sets, shingles of pivots broadcast at most (8 MB).
WORD_BITS, SHINGLE_BITS, SMALL, LARGE, PIVOTS, DEPTH, SET_BUCKETS, MOST_SHINGLES = 21, 23, 8, 256, 4, 3, 64, 1_000_000
#: Rows of a list that is broadcast at most: the driver holds each one several times over while it builds it.
MOST_ROWS = 20_000
#: Buckets sent together, and the place of the word class in an ordered shingle.
_CUT, _WORD_AT = 1 << 16, 51


def _word_bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _shingle_bucket(h: np.ndarray) -> np.ndarray:
    """Shingles' buckets come after those of words."""
    return (h >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64) + (1 << WORD_BITS)


def _hashed(w: Words, size: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice of texts (with repeats), the least of ``rare`` among each one's words, and its text."""
    h, doc = w.hashes, w.doc
    rolled, least = mixed(h), rare
    full = np.ones(len(h), bool)
    for k in range(1, size):  # a shingle begins at each word that has size - 1 more in its text
        rolled = joined(rolled, np.append(h[k:], np.zeros(min(k, len(h)), np.uint64)), k)
        least = np.minimum(least, np.append(rare[k:], np.full(min(k, len(h)), 63, np.uint8)))
        full[max(0, len(h) - k) :] = False
        full[: len(h) - k] &= doc[: len(h) - k] == doc[k:]
    out, least, owner = rolled[full], least[full], doc[full]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        ends = np.cumsum(w.counts)
        spans = [slice(ends[d] - w.counts[d], ends[d]) for d in short]
        whole = np.array([int.from_bytes(blake2b(h[x].tobytes(), digest_size=8).digest(), "little") for x in spans], np.uint64)
        out, owner = np.append(out, whole), np.append(owner, short)
        least = np.append(least, np.array([rare[x].min() for x in spans], np.uint8))
        order = np.argsort(owner, kind="stable")
        out, least, owner = out[order], least[order], owner[order]
    return out, least, owner


def shingles(part: pa.Array, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a slice of texts as ordered 63-bit numbers (with repeats), and the text of each.

    The first six bits are the shingle's class, the next six that of its rarest word: numeric order is rare first.
    """
    w = words(part)
    if not len(w.hashes):
        return w.hashes, w.doc
    out, least, owner = _hashed(w, size, table[_word_bucket(w.hashes)])
    own = table[_shingle_bucket(out)].astype(np.uint64)
    return own << np.uint64(57) | least.astype(np.uint64) << np.uint64(_WORD_AT) | out >> np.uint64(64 - _WORD_AT), owner


def frequency_classes(docs: DataFrame, size: int) -> np.ndarray:
    """How many bits the counts of words and of shingles have, by bucket, over all texts: a table of fixed size.

    1 says that a bucket's word or shingle occurs once in all texts (0 that none does). Tasks send the
    buckets they met, in cuts, which are added up by groups of tasks first; a task's counts above 255 count
    as 255, which keeps the order coarse, never wrong.
    """
    buckets = (1 << WORD_BITS) + (1 << SHINGLE_BITS)
    groups = 1 + int(docs.rdd.getNumPartitions() ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint16)
        group = 0
        for batch in each(batches):
            if batch.num_rows:
                group = int(batch.column("task")[0].as_py()) % groups
            for _, part in slices(texts(batch.column("text"))):
                w = words(part)
                if len(w.hashes):
                    out, _, _ = _hashed(w, size, np.zeros(len(w.hashes), np.uint8))
                    for met in (_word_bucket(w.hashes), _shingle_bucket(out)):
                        at, n = np.unique(met, return_counts=True)
                        counts[at] = np.minimum(counts[at] + n, 255)
        for k in range(buckets // _CUT):
            at = np.flatnonzero(counts[k * _CUT : (k + 1) * _CUT])
            if len(at):
                n = counts[k * _CUT + at].astype(np.uint32)
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["cut", "task", "at", "n"])

    def summed(table: pa.Table) -> np.ndarray:
        total = np.zeros(_CUT, np.uint32)
        for at, n in zip(table.column("at"), table.column("n"), strict=True):
            total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint32)
        return np.minimum(total, 1 << 30)

    def some(table: pa.Table) -> pa.Table:
        total = summed(table)
        at = np.flatnonzero(total)
        return pa.table({"cut": table.column("cut").slice(0, 1), "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([total[at].tobytes()], pa.binary())})

    def classes(table: pa.Table) -> pa.Table:
        bits = np.ceil(np.log2(summed(table).astype(np.float64) + 1)).astype(np.uint8)
        return pa.table({"cut": table.column("cut").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    met = docs.select("text", F.spark_partition_id().alias("task")).mapInArrow(run, "cut int, task int, at binary, n binary")
    rows = met.groupBy("cut", "task").applyInArrow(some, "cut int, at binary, n binary").groupBy("cut").applyInArrow(classes, "cut int, bits binary").toArrow()
    out = np.zeros(buckets, np.uint8)
    for k, bits in zip(rows.column("cut").to_pylist(), rows.column("bits"), strict=True):
        out[k * _CUT : (k + 1) * _CUT] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def _sets(docs: DataFrame, keys: list[str], size: int, order, window) -> DataFrame:
    """keys, n, sig (digest of the set; null for none) and the first shingles in order, as many as window says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for at, part in slices(texts(batch.column("text"))):
                ranked, doc = shingles(part, size, order.value)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                n, sigs, kept = np.zeros(len(part), np.int64), [], []
                for k in range(len(part)):
                    own = np.unique(ranked[cut[k] : cut[k + 1]])
                    n[k] = len(own)
                    sigs.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    kept.append(own[: window(len(own))])
                ends = np.append(0, np.cumsum([len(x) for x in kept]))
                flat = np.concatenate(kept).astype(np.int64) if kept else np.zeros(0, np.int64)
                yield pa.record_batch(
                    [*(batch.column(k).slice(at, len(part)) for k in keys), pa.array(n), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    [*keys, "n", "sig", "own"],
                )

    kinds = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}n long, sig binary, own array<long>")


class JaccardJoin:
    """Links between texts whose sets of ``size``-word shingles have ``100 * intersection >= percent * union``."""

    def __init__(self, size: int = 5, percent: int = 80) -> None:
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50: linked sets of two shingles or more then share two")
        self.size, self.percent = size, percent

    def _window(self):
        percent = self.percent
        # two windows within r share two shingles more than the larger set gives up, or all that the sets share
        return lambda n: min(n, n - -(-percent * n // 100) + n * 100 // percent * (100 - percent) // 200 + 2)

    def _given_up(self) -> str:
        """How many of its window's shingles a set of n gives up: half of what sets within r of it may lack."""
        return f"cast(n * {100 - self.percent} div 200 as int)"

    def _sizes_fit(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def classes(self, docs: DataFrame, rid: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Every row's doc_id, rid, n and sig; and sig with comp and component_id for each class, both written.

        ``rid`` numbers the rows of ``docs`` (by their place unless given). Where doc_ids repeat, components
        may have a component_id in common, never a comp.
        """
        order = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, self.size))
        numbered = docs.select("doc_id", "text", (F.monotonically_increasing_id() if rid is None else rid).alias("rid"))
        rows = written(_sets(numbered, ["doc_id", "rid"], self.size, order, self._window()), "jaccard-rows")
        reps = written(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("cid")), "jaccard-classes")
        held = rows.join(fitting(reps.select("cid"), MOST_ROWS), F.col("rid") == F.col("cid")).select("cid", F.col("n").cast("int").alias("n"), "own")

        regions, shown = self._regions(held)
        close = checkpointed(self._apart(self._pairs(regions.where(F.col("k") <= SMALL)), held))
        large = regions.where(F.col("k") > SMALL)
        sets = self._needed_sets(docs, rows, close.select("cid").union(close.select("pivot")).union(large.select("cid")), order)
        order.destroy()
        links, pairs = [], [close]
        for level in range(DEPTH):
            if large.isEmpty():
                break
            measured, pivots = self._against_pivots(large, sets)
            links.append(measured.where("linked AND cid <> pivot").select("cid", "pivot"))
            cells, far = self._cells(large, measured, pivots)
            parts = self._parts(cells, measured)
            parts = parts.union(self._second(far, shown) if level == 0 else far.select(parts.columns))
            sizes = written(parts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "jaccard-sizes")
            parts = written(parts.join(sizes, "key"), "jaccard-parts")
            pairs.append(self._pairs(parts if level == DEPTH - 1 else parts.where(F.col("k") <= LARGE)))
            large = parts.where(F.col("k") > LARGE).withColumn("f", F.xxhash64("cid", F.lit(level)))
        if len(pairs) > 1:
            others = self._unlinked(_union(pairs[1:]).distinct(), _union(links))
            pairs = [self._unlinked(close, _union(links)), self._apart(checkpointed(others), held)]
        pairs = _union(pairs).distinct()
        links.append(self._measured(pairs, sets, whole=False).where("linked").select("cid", "pivot"))
        labels = components(_union(links).toDF("a", "b"))
        named = reps.join(labels, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cid"))
        ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        out = written(named.join(ids, "comp").select("sig", "comp", "component_id"), "jaccard-components")
        for table in (sets, regions, shown, reps):
            dropped(table)
        return rows, out

    def joined(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles and component_id of every row of ``docs``."""
        rows, classes = self.classes(docs)
        named = rows.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(classes, "sig", "left")
        return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def _fit(self, n: Column, m: Column, apart: Column) -> Column:
        """Whether sets of n and m shingles with ``apart`` known in their symmetric difference may be within r."""
        return self._sizes_fit(n, m) & (100 * (n + m - apart) >= self.percent * (n + m + apart))

    def _regions(self, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        """key (a shingle), p, cid, n, d, rest, home, linked, f, k: what each class shows, where k > 1 classes show the same; and cid with all it shows.

        The pivot of the first level is the empty set: d is n. f is higher the fewer shingles of its own a class has, p the
        key's place among those shown. A shingle that occurs once in all texts (class 1), or with a word that does, is no other text's.
        """
        size = self._window_size()
        windows = held.select("cid", "n", F.explode("own").alias("key")).where(self._shown(F.col("key")))
        # written, so that the joins below read two exchanges and Spark splits a shingle that very many classes show
        shared = written(windows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "jaccard-shared")
        own = windows.join(shared, "key").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("k", "key"))).alias("own"))
        # the shingles of one class alone are its rarest: all that is given up is among the others
        own = own.select("cid", "n", (F.size("own") - F.expr(size)).cast("long").alias("f"), F.expr(f"slice(own.key, 1, greatest(0, size(own) - {self._given_up()}))").alias("own"))
        shown = written(own.where("size(own) > 1"), "jaccard-shown")
        # two sets within r show two shingles in common, of which the last of either is at most the second
        rows = shown.select("cid", "n", "f", F.posexplode(F.expr("slice(own, 1, size(own) - 1)")).alias("p", "key"))
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "jaccard-sizes")
        rows = rows.join(sizes, "key").select("key", "p", "cid", "n", F.col("n").alias("d"), F.col("n").alias("rest"), F.lit(True).alias("home"), F.lit(False).alias("linked"), "f", "k")
        out = written(rows, "jaccard-regions")
        for table in (shared, sizes):
            dropped(table)
        return out, shown

    def _window_size(self) -> str:
        p = self.percent
        return f"least(n, n - (n * {p} + 99) div 100 + (n * 100 div {p}) * {100 - p} div 200 + 2)"

    @staticmethod
    def _shown(h: Column) -> Column:
        return (h >= F.lit(2 << 57)) & (F.shiftright(h, _WORD_AT).bitwiseAND(F.lit(63)) > 1)

    def _pairs(self, rows: DataFrame) -> DataFrame:
        """cid, pivot: the pairs of each region, by sizes and by the shingles that can follow the key in both differences."""
        x, y = rows.alias("x"), rows.alias("y")
        apart = F.col("x.d") + F.col("y.d") - 2 * F.least("x.rest", "y.rest")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.home") | F.col("y.home")) & ~(F.col("x.linked") & F.col("y.linked"))
        return checkpointed(x.join(y, on & self._fit(F.col("x.n"), F.col("y.n"), apart)).select("x.cid", F.col("y.cid").alias("pivot")).distinct())

    def _apart(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """Pairs less those whose windows differ by more than sets within r can.

        Up to the lesser of the windows' ends both sets are known; what only one holds there belongs to the
        symmetric difference, which for sets within r is at most r / (2 - r) of the sum of sizes.
        """
        first = held.select("cid", F.col("n").alias("nx"), F.col("own").alias("x"))
        second = held.select(F.col("cid").alias("pivot"), F.col("n").alias("ny"), F.col("own").alias("y"))
        some = fitted(pairs.select("pivot").distinct(), MOST_ROWS)
        rows = first.join(fitting(pairs, MOST_ROWS), "cid").join(second.join(some, "pivot", "left_semi"), "pivot")
        whole = lambda own, n: F.size(own) == n  # noqa: E731  a set that ends within its window is known to the end
        end = F.least(F.when(~whole("x", F.col("nx")), F.element_at("x", -1)), F.when(~whole("y", F.col("ny")), F.element_at("y", -1)))
        known = lambda own: F.when(F.col("end").isNull(), F.col(own)).otherwise(F.filter(own, lambda v: v <= F.col("end")))
        rows = rows.withColumn("end", end).withColumns({"x": known("x"), "y": known("y")})
        differ = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
        # 100 both >= percent (sum - both), both = (sum - difference) / 2
        fits = 100 * (F.col("nx") + F.col("ny") - differ) >= self.percent * (F.col("nx") + F.col("ny") + differ)
        return rows.where(fits).select("cid", "pivot")

    def _needed_sets(self, docs: DataFrame, rows: DataFrame, need: DataFrame, order) -> DataFrame:
        """cid and own, the whole set, of the classes that may be measured, from one text each: a table bucketed by cid.

        Pairs are joined to it; only the pairs are shuffled.
        """
        need = checkpointed(rows.select("rid", "doc_id", "sig").join(need.distinct(), F.col("rid") == F.col("cid")).select("cid", "sig", F.col("doc_id").alias("rep")))
        ids = fitted(need.select("rep").distinct(), MOST_ROWS)
        some = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        sets = _sets(some, [], self.size, order, lambda n: n).where("n > 0").select("sig", "own")
        one = sets.join(fitting(need.select("sig", "cid"), MOST_ROWS), "sig").select("cid", "own").repartition(SET_BUCKETS, "cid").dropDuplicates(["cid"])
        return bucketed(one, "jaccard_sets", SET_BUCKETS, "cid")

    def _measured(self, pairs: DataFrame, sets: DataFrame, whole: bool) -> DataFrame:
        """cid, pivot, n, m, both (shingles of both) and linked, of distinct pairs; ``whole``: and e, the difference of the two (null beyond 3r), and d, its size.

        e is without the shingles that no other text can have. Written, so that e is only read where it is needed.
        """
        pairs = checkpointed(pairs)
        pivots = written(sets.join(fitted(pairs.select("pivot").distinct(), MOST_ROWS), F.col("cid") == F.col("pivot"), "left_semi").select(F.col("cid").alias("pivot"), F.col("own").alias("y")), "jaccard-pivots")
        small = pivots.agg(F.coalesce(F.sum(F.size("y")), F.lit(0))).first()[0] <= MOST_SHINGLES
        found = pairs.join(sets.select("cid", F.col("own").alias("x")), "cid").join(F.broadcast(pivots) if small else pivots, "pivot")
        found = found.select("cid", "pivot", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"), F.size(F.array_intersect("x", "y")).cast("long").alias("both"), *["x", "y"] * whole)
        found = found.withColumn("linked", 100 * F.col("both") >= self.percent * (F.col("n") + F.col("m") - F.col("both")))
        if whole:
            e = F.concat(F.filter(F.array_except("x", "y"), self._shown), F.array_except("y", "x"))
            e = F.when(self._distance() <= 3 * self._r(), e)  # beyond that a set is in no cell of the pivot
            found = found.withColumns({"d": F.col("n") + F.col("m") - 2 * F.col("both"), "e": e}).drop("x", "y")
        out = written(found, "jaccard-measured")
        dropped(pivots)
        return out

    @staticmethod
    def _distance() -> Column:
        return 1 - F.col("both") / (F.col("n") + F.col("m") - F.col("both"))

    def _against_pivots(self, rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What _measured says of each class and each pivot of its regions that are 3r apart at most by their sizes, the pivots themselves among them; and key, pivot and m.

        Sets whose sizes put them farther apart are in no cell of each other and need no measure.
        """

        def near(pairs: DataFrame) -> DataFrame:
            return pairs.where(F.least("n", "m") >= (1 - 3 * self._r()) * F.greatest("n", "m")).select("cid", "pivot").distinct()

        own = F.struct("f", "cid", "n")
        drawn = checkpointed(rows.groupBy("key").agg(F.max(own).alias("x")).select("key", F.col("x.cid").alias("pivot"), F.col("x.n").alias("m")))
        met = rows.select("key", "cid", "n").join(drawn, "key")
        first = self._measured(near(met), sets, whole=True)
        away = first.select("cid", "pivot", self._distance().alias("away"))
        beyond = met.join(away, ["cid", "pivot"], "left").where(F.coalesce("away", F.lit(1.0)) > 2 * self._r())
        draws = [F.max(F.struct(F.xxhash64("cid", F.lit(k)).alias("x"), "cid", "n")) for k in range(1, PIVOTS)]
        more = beyond.groupBy("key").agg(F.array_distinct(F.transform(F.array(*draws), lambda x: F.struct(x["cid"].alias("pivot"), x["n"].alias("m")))).alias("p"))
        more, (some,) = counted(more.select("key", F.inline("p")))
        if not some:
            return first, drawn
        pairs = near(rows.select("key", "cid", "n").join(more, "key")).join(first.select("cid", "pivot"), ["cid", "pivot"], "left_anti")
        return first.unionByName(self._measured(pairs, sets, whole=True)), drawn.union(more)

    def _r(self) -> float:
        return 1 - self.percent / 100 + 1e-9

    def _cells(self, rows: DataFrame, measured: DataFrame, pivots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """pivot, cid, home: the classes of each pivot's cell; and the rows of the regions whose class is over 2r from all pivots there."""
        d = measured.select("cid", "pivot", self._distance().alias("away"))
        # one row for each class of a region: its distances from all pivots there
        at = rows.select("key", "cid").join(pivots.select("key", "pivot"), "key").join(d, ["cid", "pivot"], "left").withColumn("away", F.coalesce("away", F.lit(1.0)))
        at = checkpointed(at.groupBy("key", "cid").agg(F.min("away").alias("least"), F.collect_set(F.struct("pivot", "away")).alias("all")))
        away, near = F.col("to.away"), F.col("least") <= 2 * self._r()
        inside = at.select("cid", "least", F.explode("all").alias("to")).where(away <= F.least(F.col("least") + 2 * self._r(), F.lit(3 * self._r())))
        cells = inside.groupBy(F.col("to.pivot").alias("pivot"), "cid").agg(F.max((away == F.col("least")) & near).alias("home"))
        return cells, rows.join(at.where(~near).select("key", "cid"), ["key", "cid"])

    def _second(self, far: DataFrame, shown: DataFrame) -> DataFrame:
        """Rows of first regions cut by the second shingle that sets within r show in common."""
        own = far.select("key", "p", "cid", "n", "d").join(shown.select("cid", "own"), "cid")
        own = own.select("key", "p", "cid", "n", "d", F.posexplode("own").alias("q", "e")).where("q > p")
        return own.select(F.xxhash64("key", "e").alias("key"), "cid", "n", "d", F.col("n").alias("rest"), F.lit(True).alias("home"), F.lit(False).alias("linked"))

    def _parts(self, cells: DataFrame, measured: DataFrame) -> DataFrame:
        """key (of a pivot and a shingle), cid, n, d, rest, home, linked: the regions of differences in each cell.

        ``x ^ y`` is the difference of the differences from the pivot, d_x + d_y - 2 o where they share o shingles. If
        o is 0 and x and y are within r, both are within r of the pivot and linked through it; any other pair shares a
        shingle of its differences. Sets linked to the pivot pair with the others alone, whose d is ``far`` at least, and
        d_y >= d_x - |x ^ y|: so o has a lower bound, and only the rarest shingles of a difference that such a
        bound leaves open are shown; ``rest`` is how many can follow in common. Shingles that only linked sets or only
        sets from other cells hold can be shared by no such pair and are not counted.
        """
        rows = checkpointed(measured.select("cid", "pivot", "n", "d", "linked", "e").join(cells, ["cid", "pivot"]))
        group = rows.groupBy("pivot").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("far"), F.max("n").alias("most")).where("far is not null")
        rows = rows.join(fitted(group, MOST_ROWS), "pivot")
        rows = rows.withColumn("t", F.expr(f"(n + least(most, n * 100 div {self.percent})) * {100 - self.percent} div {100 + self.percent}"))
        rows = rows.withColumn("need", F.greatest(F.lit(1), F.expr("if(linked, (d + far - t + 1) div 2, d - t)"))).where("size(e) >= need")
        each = checkpointed(rows.select("pivot", "cid", "n", "d", "need", "home", "linked", F.explode("e").alias("e")))
        # a pair that is looked for has one set that isn't linked and one at home: it shares no shingle that only others hold
        often = checkpointed(each.groupBy("pivot", "e").agg(F.count("*").alias("k"), F.every("linked").alias("idle"), F.bool_or("home").alias("near")).where("k > 1 AND near AND NOT idle").select("pivot", "e", "k"))
        own = each.join(often, ["pivot", "e"]).groupBy("pivot", "cid", "n", "d", "need", "home", "linked").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("own"))
        own = own.withColumn("s", F.size("own")).where("s >= need").withColumn("own", F.expr("slice(own, 1, cast(s - need + 1 as int))"))
        return own.select("pivot", "cid", "n", "d", "home", "linked", "s", F.posexplode("own").alias("p", "o")).select(
            F.xxhash64("pivot", "o.e").alias("key"), "cid", "n", "d", (F.col("s") - F.col("p")).alias("rest"), "home", "linked"
        )

    @staticmethod
    def _unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs that aren't linked through a pivot already."""
        balls = checkpointed(links.union(links.select("pivot", "pivot")).distinct().groupBy("cid").agg(F.collect_set("pivot").alias("balls")))
        rows = pairs.join(balls, "cid", "left").join(balls.select(F.col("cid").alias("pivot"), F.col("balls").alias("others")), "pivot", "left")
        return rows.where(~F.coalesce(F.arrays_overlap("balls", "others"), F.lit(False))).select("cid", "pivot")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: of those with its smallest doc_id one row.

    Rows are decided one by one, whatever other texts their doc_id has. Rows without a doc_id stay.
    """
    # rows are known by their place in a written table, as doc_ids and texts may repeat
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = written(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("place")), "jaccard-docs")
    rows, classes = JaccardJoin(size, percent).classes(held.select("row.doc_id", "row.text", "place"), F.col("place"))
    named = rows.where("doc_id is not null")
    firsts = named.groupBy("sig").agg(F.min(F.struct("doc_id", "rid")).alias("at"), F.count("*").alias("k"))
    firsts = firsts.join(classes.select("sig", "comp"), "sig")
    stay = firsts.groupBy("comp").agg(F.min(F.struct("at.doc_id", "sig", "at.rid")).alias("first"), F.sum("k").alias("k")).where("k > 1")
    some = fitted(classes.select("sig", "comp").join(stay, "comp").select("sig", F.col("first.rid").alias("stays")), MOST_ROWS)
    gone = fitted(named.join(some, "sig").where("rid <> stays").select(F.col("rid").alias("gone")), MOST_ROWS)
    return held.join(gone, F.col("place") == F.col("gone"), "left_anti").select("row.*")
