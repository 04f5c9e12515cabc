"""Words of many texts at once, as numpy arrays over Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D with A-Z lowered, which
is the same as ``[^\\x20\\x09-\\x0D]+`` over characters since UTF-8 keeps those
bytes to themselves. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
#: An odd base of the word hash, its inverse modulo 2^64, and multipliers that mix bits.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_ORDER = np.uint64(0xC2B2AE3D27D4EB4F)


class Words(NamedTuple):
    """``hashes`` of all words in text order, ``doc`` their text's number, ``counts`` the words of each text."""

    hashes: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers after which high and low bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= _ORDER
    x ^= x >> np.uint64(32)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        held = _powers[name] = np.cumprod(full)
    return held[:n]


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of long-offset strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_string()), "")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each one, memory that Arrow and the C library keep for themselves goes back to the system.

    Python workers outlive their tasks and share an executor's memory with its JVM.
    """
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if give_back is not None:
            give_back(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of ``texts(...)``."""
    n, buffers = len(column), column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """The column in runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    _, offsets = raw(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def words(column: pa.Array) -> Words:
    """Words of the texts of a slice."""
    data, offsets = raw(column)
    n = len(offsets) - 1
    if not len(data):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64))
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # a text begins here
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * _power("up", _BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    begin = np.searchsorted(starts, offsets)
    counts = np.diff(begin)
    return Words(hashes, np.repeat(np.arange(n), counts), counts)


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mixed(a * _BASE + (b ^ np.uint64(salt)) * _ORDER)
