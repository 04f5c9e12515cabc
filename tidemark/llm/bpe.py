"""Merge tables of public tokenizers, and the caches of words a task has met."""

from __future__ import annotations

import base64
import json
from typing import NamedTuple

import numpy as np

NONE = np.int64(1 << 40)


class Merges(NamedTuple):
    """Pairs of symbols: sorted keys ``left << 32 | right``, their rank and the symbol they make."""

    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair never merges) and symbol made of each pair."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = self.keys[at] == key
        return np.where(fits, self.rank[at], NONE), self.made[at]


def _merges(left: list[int], right: list[int], rank: list[int], made: list[int]) -> Merges:
    keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
    order = np.argsort(keys)
    return Merges(keys[order], np.array(rank, np.int64)[order], np.array(made, np.int64)[order])


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordEndModel(NamedTuple):
    """A byte-level vocabulary with a word-end mark: symbol of each byte inside and at the end of a word."""

    inside: np.ndarray
    end: np.ndarray
    merges: Merges
    special: tuple[str, ...]


def word_end_model(path: str) -> WordEndModel:
    """Read a tokenizers .json file of byte-level BPE with an end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocab, suffix = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
    letters = byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    table = _merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], list(range(len(pairs))), [vocab[a + b] for a, b in pairs])
    return WordEndModel(np.array([vocab[x] for x in letters]), np.array([vocab[x + suffix] for x in letters]), table, tuple(x["content"] for x in told["added_tokens"]))


class ByteModel(NamedTuple):
    """Byte-level ranks: each id's bytes, the id of each byte and of whole pieces, all pairs that merge."""

    pieces: list[bytes]
    ids: dict[bytes, int]
    single: np.ndarray
    merges: Merges
    restless: np.ndarray


def byte_model(path: str) -> ByteModel:
    """Read a .tiktoken file. A pair merges if its joined bytes have a rank, whichever pair first made it.

    ``restless`` marks ids that take part in a merge of a lower rank than their own.
    """
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    left, right, rank = [], [], []
    for piece, k in ids.items():
        for cut in range(1, len(piece)):
            a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(k)
    pieces: list[bytes] = [b""] * (max(ids.values()) + 1)
    for piece, k in ids.items():
        pieces[k] = piece
    restless = np.zeros(len(pieces), bool)
    l, r, k = np.array(left), np.array(right), np.array(rank)
    restless[l[l > k]] = restless[r[r > k]] = True
    restless[[ids[bytes([b])] for b in range(256)]] = False
    return ByteModel(pieces, ids, np.array([ids[bytes([b])] for b in range(256)]), _merges(left, right, rank, rank), restless)


class Numbers(dict):
    """Numbers words as they are asked for; ``new`` are those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n
