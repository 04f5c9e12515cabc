"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

The distinct pre-tokens that a block of texts brings are laid out as one linked
row of symbols. An inverted index leads from each pair's rank to its positions;
merges are replayed in rank order, each at all its positions at once, and only
the pairs of touched neighbours enter the index anew. Decoding looks each id's
bytes up again. A task encodes each distinct pre-token once and keeps a table of
bounded size; there is no shuffle.

Nulls: a null text is empty: no tokens, and the digests of no bytes. Ids may be
null or repeat; rows are encoded one by one. Other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.bpe import NONE, ByteModel, Numbers, byte_model
from tidemark.llm.words import each, texts

#: Distinct pre-tokens a task keeps before it starts its table anew, and bytes of text between replays.
MOST_KEPT = 400_000
BLOCK = 8 << 20


def replayed(words: list[bytes], model: ByteModel) -> list[np.ndarray]:
    """The ids of each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    owner = np.repeat(np.arange(len(words)), sizes)
    symbol = model.single[data]
    following = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    following[last] = -1
    before[np.append(True, last[:-1]) if n else last] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank, _ = model.merges.look(symbol[at], symbol[following[at]])
        fits = rank != NONE
        at, rank = at[fits], rank[fits]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
        for a, b in zip(cuts, [*cuts[1:], len(rank)], strict=False):
            r = int(rank[a])
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(ranks, r)

    enter(np.flatnonzero(following >= 0))
    while ranks:
        r = heapq.heappop(ranks)
        found = index.pop(r)
        at = np.sort(found[0]) if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[alive[at]]
        at = at[following[at] >= 0]
        rank, made = model.merges.look(symbol[at], symbol[following[at]])
        at = at[rank == r]
        if not len(at):
            continue
        if model.restless[r]:  # a merge of a lower rank may follow: one position of a word at a time
            first = np.append(True, owner[at[1:]] != owner[at[:-1]])
            if not first.all():
                index[r] = [at[~first]]
                heapq.heappush(ranks, r)
                at = at[first]
        touching = following[at[:-1]] == at[1:]
        if touching.any():  # aaa: of touching positions every other one merges, from the left
            kept, end = [], -1
            for p, q in zip(at.tolist(), following[at].tolist(), strict=True):
                if p != end:
                    kept.append(p)
                    end = q
            at = np.array(kept)
        gone = following[at]
        symbol[at] = r
        alive[gone] = False
        beyond = following[gone]
        following[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        left = before[at]
        enter(np.concatenate([left[left >= 0], at[beyond >= 0]]))
    ends = np.searchsorted(owner[alive], np.arange(len(words) + 1))
    left = symbol[alive]
    return [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoded(words: list[bytes], model: ByteModel) -> list[list[int]]:
    """The ids of each word: a word that is itself a piece is that piece, the others are replayed."""
    whole = [model.ids.get(w) for w in words]
    rest = iter(replayed([w for w, k in zip(words, whole, strict=True) if k is None], model))
    return [next(rest).tolist() if k is None else [k] for k in whole]


def decoded(ids: list[int], model: ByteModel) -> bytes:
    """The bytes of ids."""
    return b"".join(map(model.pieces.__getitem__, ids))


class _Coder:
    def __init__(self, model: ByteModel, pattern: str) -> None:
        self.model, self.find = model, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number, self.size, self.told, self.bytes = Numbers(), [], [], []

    def code(self, column: list[str]) -> tuple[list[int], list[str], list[str]]:
        if len(self.number) > MOST_KEPT:
            self.clear()
        ask = self.number.__getitem__
        rows = [np.fromiter(map(ask, found := self.find(text)), np.int32, len(found)) for text in column]
        if self.number.new:
            for ids in encoded([w.encode() for w in self.number.new], self.model):
                self.size.append(len(ids))
                self.told.append(" ".join(map(str, ids)).encode())
                self.bytes.append(decoded(ids, self.model))
            self.number.new.clear()
        sizes, ids, back = np.array(self.size, np.int64), [], []
        for row in rows:
            listed = row.tolist()
            ids.append(sha256(b" ".join(map(self.told.__getitem__, listed))).hexdigest())
            back.append(sha256(b"".join(map(self.bytes.__getitem__, listed))).hexdigest())
        return [int(sizes[row].sum()) for row in rows], ids, back


def coded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    The vocabulary, of a size fixed by its file, is read here and broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(byte_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.words import slices

        coder = _Coder(sent.value, pattern)
        for batch in each(batches):
            for at, part in slices(texts(batch.column("text")), BLOCK):
                sizes, ids, back = coder.code(part.to_pylist())
                yield pa.record_batch([batch.column("doc_id").slice(at, len(part)), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
