"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Every run holds a Lyndon word as its root under the order of words or under its
inverse, and that root is the longest Lyndon word from where it starts. The text is
therefore scanned from right to left under both orders with a stack of Lyndon words:
a new word joins those on the stack as long as its suffix is smaller than theirs.
Suffixes are compared, and roots extended to both sides, by their longest common
extension: binary search over rolling hashes, then the words themselves; no suffix
array is made. A stretch that a known run holds answers from that run.

A run's words all lie in stretches covered by 4-word windows that occur twice or
more in the text (each window of a run recurs one period on or back, but for those
across the middle of a square, whose words other windows cover). Only these
stretches are scanned; windows that merely share a hash widen a stretch, no more.
Texts are read one by one, so there is no shuffle; words are numbers by their exact
bytes, case kept.

Nulls: a null text has no words and no runs, and the digests of nothing. Ids may be
null (such a row's words stay as they are) or repeat. Other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.words import each, mixed, raw, slices, texts

#: The least words of a run; windows that a run repeats.
LEAST = 12
WINDOW = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Common extensions shorter than this are found word by word.
_NEAR = 8


class Run(NamedTuple):
    """Words ``start`` to ``end`` (not included) with smallest period ``period``."""

    start: int
    end: int
    period: int


class _Stretch:
    """Numbered words of a stretch, with rolling hashes and their bytes for direct comparison."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.words = numbers.tolist()
        self.n = len(self.words)
        self.bytes = memoryview(np.ascontiguousarray(numbers, np.int32)).cast("B")
        self.hashed: tuple[list[int], list[int]] | None = None
        self.known: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, n: int) -> bool:
        """Whether the ``n`` words from ``i`` on have the hash of those from ``j`` on, i < j."""
        if self.hashed is None:
            powers = np.full(self.n + 1, _BASE, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(mixed(np.array(self.words, np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
            self.hashed = sums.tolist(), powers.tolist()
        sums, powers = self.hashed
        return (sums[i + n] - sums[i]) * powers[j - i] & _MASK == sums[j + n] - sums[j] & _MASK

    def equal(self, i: int, j: int, n: int) -> bool:
        """Whether the words themselves are equal."""
        return self.bytes[4 * i : 4 * (i + n)] == self.bytes[4 * j : 4 * (j + n)]

    def _searched(self, most: int, near: int, at: Callable[[int], tuple[int, int]]) -> int:
        """The largest length up to ``most`` whose words agree; those up to ``near`` do. ``at`` gives both starts of a length."""
        low, high, test = near, most, self.same
        for test in (self.same, self.equal):  # by hash, and by the words alone should a hash have been wrong
            while low < high:
                mid = (low + high + 1) // 2
                if test(*at(mid), mid):
                    low = mid
                else:
                    high = mid - 1
            if self.equal(*at(low), low):
                return low
            low, high = near, low - 1
        return low

    def ahead(self, i: int, j: int) -> int:
        """How many words agree from ``i`` and from ``j`` on, i < j."""
        words, most = self.words, self.n - j
        near = 0
        while near < most and words[i + near] == words[j + near]:
            near += 1
            if near == _NEAR:
                held = self.known.get(j - i)
                if held and held[0] <= i and j + near <= held[1]:
                    return held[1] - j
                return self._searched(most, near, lambda n: (i, j))
        return near

    def behind(self, i: int, j: int) -> int:
        """How many words agree before ``i`` and before ``j``, i < j."""
        words, near = self.words, 0
        while near < i and words[i - 1 - near] == words[j - 1 - near]:
            near += 1
            if near == _NEAR:
                return self._searched(i, near, lambda n: (i - n, j - n))
        return near

    def roots(self, sign: int) -> Iterator[tuple[int, int]]:
        """From right to left each word's place and the length of the longest Lyndon word that starts there; ``sign`` -1 inverts the order of words. A text's end is less than any word."""
        n, words = self.n, self.words
        follows = [0] * (n + 1)  # where the suffix starts that is the next smaller one
        follows[n] = n
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                d = words[i] - words[j]
                if d == 0:
                    k = self.ahead(i, j)
                    if j + k == n:
                        break  # the later suffix is a part of the earlier one, so smaller
                    d = words[i + k] - words[j + k]
                if d * sign > 0:
                    break
                j = follows[j]
            follows[i] = j
            yield i, j - i

    def runs(self, least: int) -> set[Run]:
        """All runs of ``least`` words or more."""
        found = set()
        for sign in (1, -1):
            for i, period in self.roots(sign):
                held = self.known.get(period)
                if held and held[0] <= i and i + period <= held[1]:
                    continue
                j = i + period
                start = i - self.behind(i, j)
                end = j + (self.ahead(i, j) if j < self.n else 0)
                if end - start >= 2 * period:
                    self.known[period] = (start, end)
                    if end - start >= least:
                        found.add(Run(start, end, period))
        return found


def stretches(numbers: np.ndarray, least: int = LEAST, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of ``least`` words or more that are covered by windows which occur twice or more."""
    n = len(numbers) - window + 1
    if n < 2 or len(numbers) < least:
        return []
    held = np.zeros(n, np.uint64)
    for k in range(window):
        held = mixed(held * np.uint64(_BASE) + numbers[k : k + n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(held)
    twice = held[order[1:]] == held[order[:-1]]
    if not twice.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][twice]] = True
    again[order[:-1][twice]] = True
    covered = np.zeros(len(numbers) + 2, np.int8)
    for k in range(window):
        covered[1 + k : 1 + k + n] |= again
    edges = np.flatnonzero(np.diff(covered))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def runs_of(numbers: np.ndarray, least: int = LEAST) -> list[Run]:
    """The runs of numbered words, by start, then period."""
    found = []
    for at, end in stretches(numbers, least):
        found += [Run(at + r.start, at + r.end, r.period) for r in _Stretch(numbers[at:end]).runs(least)]
    return sorted(found, key=lambda r: (r.start, r.period))


def looped(words: list[bytes], doc_id: object) -> list[bytes]:
    """Words made periodic from a place on, where the doc_id's checksum says so."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    root = words[at : at + period]
    return words[:at] + (root * -(-(n - at) // period))[: n - at]


def _numbered(words: list[bytes]) -> np.ndarray:
    held: dict[bytes, int] = {}
    number = held.setdefault
    return np.array([number(w, len(held)) for w in words], np.int32)


def described(words: list[bytes]) -> tuple:
    """n_runs, start, length, period and exponent_milli of the longest run, and the digests of all runs and of the words that are no repeats."""
    found = runs_of(_numbered(words)) if len(words) >= LEAST else []
    kept = words
    if found:
        keep = bytearray(b"\1") * len(words)
        for r in found:
            keep[r.start + r.period : r.end] = bytes(r.end - r.start - r.period)
        kept = [w for w, k in zip(words, keep, strict=True) if k]
    listed = "".join(f"{r.start},{r.end - r.start},{r.period}\n" for r in found)
    digests = sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()
    if not found:
        return 0, None, None, None, None, *digests
    best = min(found, key=lambda r: (r.start - r.end, r.start, r.period))
    size = best.end - best.start
    return len(found), best.start, size, best.period, 1000 * size // best.period, *digests


SCHEMA = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def detected(docs: DataFrame, loop: bool = False) -> DataFrame:
    """doc_id and :func:`described` of every row of ``docs``; with ``loop`` of words that :func:`looped` has changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for at, part in slices(texts(batch.column("text")), 8 << 20):
                ids = batch.column("doc_id").slice(at, len(part))
                data, offsets = raw(part)
                whole, rows = data.tobytes(), []
                for doc_id, a, b in zip(ids.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = _WORD.findall(whole, a, b)
                    rows.append(described(looped(words, doc_id) if loop else words))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)]
                yield pa.record_batch([ids, *columns], ["doc_id", *SCHEMA.names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
