"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning takes a bounded sample of labelled rows (``max_train``, taken in the
order of a hash of doc_id), whose texts become arrays of distinct feature numbers
in parallel; one task then runs FTRL-proximal over them. L1 leaves few weights
other than zero, and only those reach the driver and the workers, so what is
broadcast never exceeds ``2**bits`` pairs however large the corpus is. Scoring is
one pass over the texts without a shuffle.

Nulls: a null text is empty and scores as the bias alone; a null doc_id is never
learnt from; null labels are no labels, and of several labels of a doc_id the
largest counts. Without any label every score is 0. Repeated rows are scored
each. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, each, joined, mixed, slices, texts, words

MAX_TRAIN = 12_000
BITS = 22
THRESHOLD = 0.3


def features(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, of neighbours and of words one apart, and the text of each."""
    h, doc = w.hashes, w.doc
    pair, skip = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    found = np.concatenate([mixed(h), joined(h[:-1], h[1:], 2)[pair], joined(h[:-2], h[2:], 3)[skip]])
    return (found >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([doc, doc[:-1][pair], doc[:-2][skip]])


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5, least: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of FTRL-proximal: a rate for each coordinate, and L1 that keeps weak ones at zero.

    Features of fewer than ``least`` texts are not learnt, so that no text is learnt by heart.
    """
    if rows:
        often = np.bincount(np.concatenate(rows), minlength=1 << bits) >= least
        rows = [r[often[r]] for r in rows]
    z, n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    base = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)) if len(labels) else 0.0
    shift, seen = 0.0, 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + base + shift, -30, 30)))
            g = p - labels[k]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            seen += g * g
            shift -= 0.05 * g / (1 + np.sqrt(seen))
    return weights(np.arange(1 << bits)).astype(np.float32), float(base + shift)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_train: int = MAX_TRAIN, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the features that L1 left; the last is the bias under number ``2**bits``.

    ``learn`` is a condition on doc_id. ``labels`` has doc_id and toxic. Labels are drawn of doc_ids that ``docs`` has;
    of one that repeats a single row is learnt, that with the least hash of its text.
    """
    sample = (
        labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for at, part in slices(texts(batch.column("text"))):
                x, doc = features(words(part), bits)
                key = np.unique(doc << bits | x)
                cut = np.searchsorted(key >> bits, np.arange(len(part) + 1))
                x = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.record_batch([batch.column("doc_id").slice(at, len(part)), batch.column("toxic").slice(at, len(part)), x], ["doc_id", "toxic", "x"])

    def trained(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        x = table.column("x")
        x = x.chunk(0) if x.num_chunks else pa.array([], pa.list_(pa.int32()))
        flat, cut = x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        weights, bias = ftrl([flat[a:b] for a, b in zip(cut, cut[1:], strict=False)], table.column("toxic").to_numpy(), bits)
        at = np.flatnonzero(weights)
        return pa.table({"at": pa.array(np.append(at, 1 << bits), pa.int64()), "weight": pa.array(np.append(weights[at], bias), pa.float64())})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = (
        docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .mapInArrow(featured, f"doc_id {id_type}, toxic int, x array<int>")
        .withColumns({"order": F.xxhash64("doc_id"), "model": F.lit(0)})
    )
    got = rows.groupBy("model").applyInArrow(trained, "at long, weight double").toArrow()
    return got.column("at").to_numpy(), got.column("weight").to_numpy()


def _scores(column: pa.Array, table: np.ndarray | None, bias: float, bits: int) -> np.ndarray:
    out = np.full(len(column), bias)
    if table is None:
        return np.zeros(len(column))
    for at, part in slices(column):
        x, doc = features(words(part), bits)
        weight = table[x]
        hit = np.flatnonzero(weight)
        key, first = np.unique(doc[hit] << bits | x[hit], return_index=True)  # presence, not frequency
        out[at : at + len(part)] += np.bincount(key >> bits, weight[hit][first], len(part))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _scorer(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int):
    at, weight = model
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weight.astype(np.float32)))
    held: dict = {}

    def score(column: pa.Array) -> np.ndarray:
        if "table" not in held:
            at, weight = sent.value
            held["table"], held["bias"] = None, 0.0
            if len(at):
                held["table"], held["bias"] = np.zeros(1 << bits, np.float32), float(weight[-1])
                held["table"][at[:-1]] = weight[:-1]
        return _scores(texts(column), held["table"], held["bias"], bits)

    return score


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    score = _scorer(docs, model, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(score(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    score = _scorer(docs, model, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            yield batch.filter(pa.array(score(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
