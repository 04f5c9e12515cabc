"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts are held as one ragged numpy array. In each round every
sequence applies its own lowest-rank pair, all sequences at once, until no pair
merges; the symbols that survive are counted. A task merges each distinct
pre-token once and keeps the counts in a table of bounded size, so texts of any
number stream through bounded memory, without a shuffle.

Nulls: a null text is empty and has 0 tokens; ids may be null or repeat, rows are
counted one by one. Special strings inside a text count as one token each, as the
library does by default. Other columns are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.bpe import NONE, Numbers, WordEndModel, word_end_model
from tidemark.llm.words import each, texts

#: The pattern of pre-tokens, as the vocabulary's file states it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct pre-tokens a task keeps before it starts its table anew.
MOST_KEPT = 400_000


def surviving(words: list[bytes], model: WordEndModel) -> np.ndarray:
    """The number of symbols that each word's bytes end as."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    out = np.zeros(len(words), np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    symbol = model.inside[data]
    last = np.cumsum(sizes)[sizes > 0] - 1
    symbol[last] = model.end[data[last]]
    rank = np.full(len(symbol), NONE)
    made = np.zeros(len(symbol), np.int64)
    stale = np.ones(len(symbol), bool)  # pairs to look up: this symbol and the next
    while len(symbol):
        inner = np.append(owner[1:] == owner[:-1], False)
        rank[~inner] = NONE
        at = np.flatnonzero(stale & inner)
        rank[at], made[at] = model.merges.look(symbol[at], symbol[at + 1])
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(rank, starts)
        done = best == NONE
        lengths = np.diff(np.append(starts, len(symbol)))
        out[owner[starts[done]]] = lengths[done]
        hit = (rank == np.repeat(best, lengths)) & (rank != NONE)
        run = np.flatnonzero(hit[1:] & hit[:-1])  # a pair that overlaps the one before, as in aaa
        if len(run):
            order = np.arange(len(hit))
            since = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), order, 0))
            hit &= (order - since) % 2 == 0
        at = np.flatnonzero(hit)
        symbol[at] = made[at]
        stale = hit.copy()
        stale[np.maximum(at - 1, 0)] = True
        keep = np.repeat(~done, lengths)
        keep[at + 1] = False
        # a merged symbol's left neighbour must be looked up again even where a removed symbol lies between
        before = np.flatnonzero(keep)
        moved = hit[before]
        symbol, owner, rank, made = symbol[keep], owner[keep], rank[keep], made[keep]
        stale = moved.copy()
        stale[:-1] |= moved[1:]
    return out


class _Counter:
    def __init__(self, model: WordEndModel) -> None:
        self.model = model
        self.find = regex.compile(SPLIT).findall
        self.special = regex.compile("|".join(map(regex.escape, model.special))) if model.special else None
        self.clear()

    def clear(self) -> None:
        self.number, self.count = Numbers(), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings: composed, each character lowered by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def counts(self, column: list[str]) -> np.ndarray:
        if len(self.number) > MOST_KEPT:
            self.clear()
        ask, rows, extra = self.number.__getitem__, [], np.zeros(len(column), np.int64)
        for k, text in enumerate(column):
            if self.special and "<|" in text:
                extra[k] = len(self.special.findall(text))
                found = [w for part in self.special.split(text) for w in self.words(part)]
            else:
                found = self.words(text)
            rows.append(np.fromiter(map(ask, found), np.int64, len(found)))
        if self.number.new:
            self.count = np.append(self.count, surviving([w.encode() for w in self.number.new], self.model))
            self.number.new.clear()
        return extra + np.array([self.count[r].sum() for r in rows], np.int64)


def counted(docs: DataFrame, path: str, limit: int = 2048, rows: int = 500) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    The vocabulary, of a size fixed by its file, is read here and broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(word_end_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(sent.value)
        for batch in each(batches):
            column = texts(batch.column("text"))
            tokens = np.concatenate([np.zeros(0, np.int64), *(counter.counts(column.slice(k, rows).to_pylist()) for k in range(0, len(column), rows))])
            size = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)) if len(column) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
