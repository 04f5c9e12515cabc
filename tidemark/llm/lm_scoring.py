"""Language-model scoring by a log-frequency Bloom filter, beside an exact unigram base.

Words are counted first: every task sums its words as sorted hash arrays, cut into
blocks by hash; one shuffle of such arrays adds the blocks up, whatever key is hot.
All words and pairs are kept.

The filter: an n-gram of quantised log count q is inserted with all levels from 1 up to
q; a count is read back by probing level after level until one misses. Nothing is
pruned: the filter grows with the corpus, at the false-positive rate that ``PROBES``
hashes give. Where the tokens learnt bound it by ``MAX_BITS`` the driver strings its
blocks together and broadcasts them. A larger filter never leaves its blocks: texts
are dealt into chunks, each chunk sends its distinct n-grams with their counts to the
blocks, each block adds them up, is built, and answers with the level that its filter
has for every n-gram sent; the levels come back to the chunk's texts. Scores are the same either
way but for false positives. Pairs are smoothed by words: ``(c(h, w) + WEIGHT p(w)) / (c(h) + WEIGHT)``,
all counts probed.

The base needs exact counts of all words. Those of the most frequent (at most ``HOT``,
12 bytes each) are broadcast; a text's other words are joined to the count table by
word hash and summed by row. Words are known by 64-bit hashes: with V different words,
V^2 / 2^65 pairs are expected to share one.

Nulls: a null text is empty, its only token the end; a null doc_id is neither learnt
nor held out by a condition that is null on it (it is scored). Repeated rows are
counted and scored each. With nothing learnt N and V are 0 and every token has
probability 1. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import each, joined, mixed, slices, texts, words
from tidemark.shared import dropped, written

#: Words whose exact counts are broadcast at most; bits of a broadcast filter at most; hash probes a level; the words' weight in a pair's count.
HOT, MAX_BITS, PROBES, WEIGHT = 200_000, 1 << 28, 8, 8.0
#: Ratio of neighbouring quantised counts.
RATIO = 2**0.5
_END, _START = np.uint64(0x1D8AF066E7D1E11B), np.uint64(0x5851F42D4C957F2D)
_WORD = np.uint64(0xA24BAED4963EE407)
_FLUSH = 3 << 20
#: Bytes of the texts of a chunk, but for longer texts.
_CHUNK = 16 << 20
LEVELS = 128


def tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice of texts, each text's words and then the end, and the text of each."""
    w = words(part)
    ends = np.cumsum(w.counts)
    return np.insert(w.hashes, ends, _END), np.insert(w.doc, ends, np.arange(len(part)))


def pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor (the start for a text's first) and the hash of the pair."""
    before = np.append(_START, h[:-1]) if len(h) else h
    if len(h):
        before[1:][doc[1:] != doc[:-1]] = _START
    return before, joined(before, h, 5)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised log count, from 1."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its counts; 0 for level 0."""
    return np.where(levels == 0, 0.0, np.maximum(np.floor(RATIO ** np.maximum(levels - 1, 0) * (1 + RATIO) / 2), 1))


def _partial(keys: np.ndarray, counts: np.ndarray, order: int, shift: int) -> pa.RecordBatch:
    """Sorted keys and their counts, a row for each block."""
    blocks = (keys >> np.uint64(shift)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(keys))
    columns = [
        pa.array(blocks[starts], pa.int64()),
        pa.array(np.full(len(starts), order), pa.int32()),
        pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
    ]
    return pa.record_batch(columns, ["block", "order", "keys", "counts"])


def ngram_counts(docs: DataFrame, blocks: int, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """block, order, keys, counts, total, different, shown (n-grams of each level): all words (1), pairs (2) or both."""
    shift = 64 - (blocks.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {order: [] for order in orders}
        n = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for order, some in held.items():
                yield _partial(*np.unique(np.concatenate(some), return_counts=True), order, shift)
                some.clear()

        for batch in each(batches):
            for _, part in slices(texts(batch.column("text"))):
                h, doc = tokens(part)
                for order in orders:
                    held[order].append(mixed(h ^ _WORD) if order == 1 else pairs(h, doc)[1])
                n += len(h)
                if n > _FLUSH:
                    yield from sums()
                    n = 0
        if n:
            yield from sums()

    def add(table: pa.Table) -> pa.Table:
        out = []
        for order in orders:
            some = table.filter(pa.compute.equal(table.column("order"), order))
            if not some.num_rows:
                continue
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in some.column("keys").to_pylist()])
            counts = np.concatenate([np.frombuffer(x, np.uint32) for x in some.column("counts").to_pylist()]).astype(np.int64)
            by = np.argsort(keys, kind="stable")
            keys, counts = keys[by], counts[by]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
            total, different = int(counts.sum()), len(keys)
            shown = np.bincount(level(counts), minlength=LEVELS + 1).tolist()
            out.append((table.column("block")[0].as_py(), order, keys.tobytes(), counts.tobytes(), total, different, shown))
        kinds = pa.schema([("block", pa.int64()), ("order", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("different", pa.int64()), ("shown", pa.list_(pa.int64()))])
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    partial = docs.select("text").mapInArrow(count, "block long, order int, keys binary, counts binary")
    return partial.groupBy("block").applyInArrow(add, "block long, order int, keys binary, counts binary, total long, different long, shown array<long>")


class Filter(NamedTuple):
    """``bits`` in blocks by a key's first bits."""

    bits: np.ndarray
    blocks: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key: levels are probed from 1 until one misses; 0 if that misses."""
        out = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            for k in range(PROBES):
                if not len(at):
                    return out
                where = _place(keys[at], q, k, len(self.bits) * 8, self.blocks)
                at = at[(self.bits[where >> 3] >> (where & 7).astype(np.uint8) & 1).astype(bool)]
            out[at] = q
        return out


def _place(keys: np.ndarray, q: int, k: int, size: int, blocks: int) -> np.ndarray:
    """The bit of probe k for level q: inside the key's own block."""
    each = size // blocks
    shift = np.uint64(64 - (blocks.bit_length() - 1)) if blocks > 1 else None
    base = (keys >> shift).astype(np.int64) * each if shift is not None else np.zeros(len(keys), np.int64)
    return base + (mixed(keys + np.uint64(q * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) & np.uint64(each - 1)).astype(np.int64)


def measured(table: DataFrame, blocks: int) -> tuple[int, int, int, np.ndarray]:
    """Bits of the filter, N, V and how many words have each quantised count; from :func:`ngram_counts`."""
    rows = table.select("order", "total", "different", F.posexplode("shown").alias("q", "n"))
    rows = rows.groupBy("order", "q").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    sums = {r["order"]: r for r in table.groupBy("order").agg(F.sum("total").alias("total"), F.sum("different").alias("different")).toArrow().to_pylist()}
    shown = np.zeros((3, LEVELS + 1), np.int64)
    for r in rows:
        shown[r["order"], r["q"]] = r["n"]
    need = int((shown * np.arange(LEVELS + 1)).sum()) * PROBES / np.log(2)
    size = max(64 * 8 * blocks, 1 << int(np.ceil(np.log2(max(need, 1)))))
    n, v = (int(sums[1][k]) if 1 in sums else 0 for k in ("total", "different"))
    return size, n, v, shown[1]


def _block(held: list[tuple[bytes, bytes]], size: int) -> Filter:
    """The filter of ``size`` bits of one block, from keys and counts of its n-grams."""
    part = np.zeros(size, bool)
    for keys, counts in held:
        keys, q = np.frombuffer(keys, np.uint64), level(np.frombuffer(counts, np.int64))
        for j in range(1, int(q.max(initial=0)) + 1):
            for k in range(PROBES):
                part[_place(keys[q >= j], j, k, size, 1)] = True
    return Filter(np.packbits(part, bitorder="little"), 1)


def strung(table: DataFrame, blocks: int, size: int) -> Filter:
    """The filter as a whole."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for block, *held in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "counts")), strict=True):
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([_block([held], size // blocks).bits.tobytes()], pa.binary())], ["block", "part"])

    bits = np.zeros(size // 8, np.uint8)
    built = table.select("block", "keys", "counts").mapInArrow(build, "block long, part binary").toArrow()
    for block, part in zip(built.column("block").to_pylist(), built.column("part"), strict=True):
        at = block * (size // blocks // 8)
        bits[at : at + size // blocks // 8] |= np.frombuffer(part.as_buffer(), np.uint8)
    return Filter(bits, blocks)


def chunked(numbered: DataFrame, most: int) -> DataFrame:
    """Rows with the chunk of about ``most`` bytes of texts that each is dealt to."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = 0, most
        for batch in each(batches):
            for at, part in slices(texts(batch.column("text"))):
                if size >= most:
                    chunk, size = batch.column("rid")[at].as_py(), 0
                size += part.nbytes
                some = batch.slice(at, len(part))
                yield pa.record_batch([*some.columns, pa.array(np.full(len(part), chunk))], [*some.schema.names, "chunk"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(deal, f"{kinds}, chunk long")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _asked(chunk: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Different words (1) and pairs (2) of a chunk's texts, sorted, and how often they occur where ``learn`` holds."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 2: []}
    learn = chunk.column("learn").combine_chunks().to_numpy(zero_copy_only=False)
    for at, part in slices(texts(chunk.column("text"))):
        h, doc = tokens(part)
        own = learn[at : at + len(part)][doc]
        for order, keys in ((1, mixed(h ^ _WORD)), (2, pairs(h, doc)[1])):
            different, of = np.unique(keys, return_inverse=True)
            held[order].append((different, np.bincount(of[own], minlength=len(different))))
    return {order: _added(some) for order, some in held.items()}


def answers(dealt: DataFrame, blocks: int) -> DataFrame:
    """chunk, order, block, levels (a byte for each key in turn) of the n-grams of each chunk of texts."""
    shift = 64 - (blocks.bit_length() - 1)

    def ask(chunk: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_partial(*some, order, shift) for order, some in _asked(chunk).items()])
        return out.append_column("chunk", pa.array(np.full(len(out), chunk.column("chunk")[0].as_py())))

    def answer(asked: pa.Table) -> pa.Table:
        rows = [(np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)) for k, n in zip(asked.column("keys"), asked.column("counts"), strict=True)]
        keys, counts = _added(rows)
        learnt = counts > 0
        need = int(level(counts[learnt]).sum()) * PROBES / np.log(2)
        bloom = _block([(keys[learnt].tobytes(), counts[learnt].tobytes())], max(512, 1 << int(np.ceil(np.log2(max(need, 1))))))
        levels = bloom.levels(keys).astype(np.uint8)  # each key is probed once, whoever asked
        found = [levels[np.searchsorted(keys, k)].tobytes() for k, _ in rows]
        return asked.select(["chunk", "order", "block"]).append_column("levels", pa.array(found, pa.binary()))

    # all columns, so that Spark deals the texts out once for this and for the scores
    asked = dealt.groupBy("chunk").applyInArrow(ask, "block long, order int, keys binary, counts binary, chunk long")
    return asked.groupBy("block").applyInArrow(answer, "chunk long, order int, block long, levels binary")


def _word_rows(table: DataFrame) -> DataFrame:
    """key, n of every word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["key", "n"])

    return table.where("order = 1").select("keys", "counts").mapInArrow(rows, "key long, n long")


def scored(docs: DataFrame, learn: Column, weight: float = WEIGHT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``, learnt where ``learn`` holds."""
    spark = docs.sparkSession
    blocks = 1 << max(4, (16 * docs.rdd.getNumPartitions() - 1).bit_length())
    table = written(ngram_counts(docs.where(learn), blocks, (1,)), "lm-words")
    _, n, v, shown = measured(table, blocks)
    bloom = None
    if 3 * n * PROBES / np.log(2) <= MAX_BITS:  # the levels of words, and of pairs, are 1.5 times the tokens at most
        both = written(ngram_counts(docs.where(learn), blocks), "lm-counts")
        bloom = strung(both, blocks, measured(both, blocks)[0])
        dropped(both)
    counts = _word_rows(table)
    # the lowest quantised count from which no more than HOT words have it
    many = np.cumsum(shown[::-1])[::-1]
    least = int(np.argmax(many <= HOT))
    hot = counts.where(F.col("n") >= int(np.ceil(RATIO ** (least - 1) - 1e-6))).toArrow()
    keys, often = hot.column("key").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    by = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[by], often[by].astype(np.float64), bloom))
    total = n + 0.5 * (v + 1)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def batch_scores(batch: pa.RecordBatch | pa.Table, levels: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, often, _ = sent.value
        ids, rids = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column("doc_id"), batch.column("rid")))
        for at, part in slices(texts(batch.column("text"))):
            h, doc = tokens(part)
            before, pair = pairs(h, doc)
            word = mixed(h ^ _WORD)
            different, of = np.unique(word, return_inverse=True)
            known = np.zeros(len(different))
            if len(keys):
                place = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
                known = np.where(keys[place] == different, often[place], 0.0)
            c = known[of]
            base = np.bincount(doc[c > 0], np.log10((c[c > 0] + 0.5) / total), len(part)).astype(np.float64)
            sure = np.bincount(doc[c > 0], minlength=len(part))
            # the model: words' and pairs' counts as the filter has them
            q = levels(different, 1)
            words_count = count_of(q)
            single = (words_count[of] + 0.5) / total
            history = np.append(0, of[:-1]) if len(of) else of
            begins = before == _START
            context = np.where(begins, 0.0, words_count[history])
            both = (context > 0) & (q[of] > 0)
            at_start = np.flatnonzero(begins & (q[of] > 0))
            seen = np.zeros(len(h))
            ask = np.append(np.flatnonzero(both), at_start)
            seen[ask] = count_of(levels(pair[ask], 2))
            context[begins] = context_start(levels) if len(h) else 0.0
            seen = np.minimum(seen, np.minimum(context, words_count[of]))  # no pair is more frequent than its words
            p = (seen + weight * single) / (context + weight)
            model = np.bincount(doc, np.log10(np.minimum(p, 1.0)), len(part)).astype(np.float64)
            # words not broadcast go to the join, summed by text
            cold = np.flatnonzero(c == 0)
            key, times = np.unique(np.stack([doc[cold].astype(np.uint64), word[cold]]), axis=1, return_counts=True) if len(cold) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            cut = pa.array(np.searchsorted(key[0].astype(np.int64), np.arange(len(part) + 1)), pa.int32())
            size = np.bincount(doc, minlength=len(part))
            yield pa.record_batch(
                [ids.slice(at, len(part)), rids.slice(at, len(part)), pa.array(size), pa.array(sure), pa.array(base), pa.array(model),
                 pa.ListArray.from_arrays(cut, pa.array(key[1].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times))],
                ["doc_id", "rid", "n_tokens", "sure", "base", "score", "cold", "times"],
            )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            yield from batch_scores(batch, lambda asked, _: sent.value[2].levels(asked))

    def chunk_scores(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        distinct = {order: keys for order, (keys, _) in _asked(chunk).items()}
        answered = answered.sort_by([("order", "ascending"), ("block", "ascending")])
        got = np.frombuffer(b"".join(answered.column("levels").to_pylist()), np.uint8).astype(np.int64)
        found = dict(zip(distinct, np.split(got, [len(distinct[1])]), strict=True))
        return pa.Table.from_batches(list(batch_scores(chunk, lambda asked, order: found[order][np.searchsorted(distinct[order], asked)])))

    kinds = f"doc_id {id_type}, rid long, n_tokens long, sure long, base double, score double, cold array<long>, times array<long>"
    numbered = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"), F.monotonically_increasing_id().alias("rid"))
    if bloom is not None:
        rows = written(numbered.mapInArrow(score, kinds), "lm-rows")
    else:
        dealt = chunked(numbered, _CHUNK)
        rows = written(dealt.groupBy("chunk").cogroup(answers(dealt, blocks).groupBy("chunk")).applyInArrow(chunk_scores, kinds), "lm-rows")
    cold = rows.select("rid", F.explode(F.arrays_zip("cold", "times")).alias("c")).select("rid", F.col("c.cold").alias("key"), F.col("c.times").alias("times"))
    found = cold.join(counts.where(F.col("n") < int(np.ceil(RATIO ** (least - 1) - 1e-6))), "key", "left")
    found = found.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total))).alias("cold_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("cold_known"),
    )
    return rows.select("doc_id", "rid", "n_tokens", "sure", "base", "score").join(found, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("sure") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"), "score",
    )


def context_start(levels: Callable[[np.ndarray, int], np.ndarray]) -> float:
    """The number of texts learnt, as the filter has it: each has one end."""
    return float(count_of(levels(mixed(np.array([_END]) ^ _WORD), 1))[0])
