"""Vectorised words and hashes over Arrow string columns.

All functions work on the bytes behind an Arrow column, so that one numpy call
serves many documents.  A word is a maximal run of bytes other than
``0x20`` and ``0x09``-``0x0D``; as these are ASCII, UTF-8 text splits at the same
places as its code points do.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers made from ``seed``."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_NODE = constants(64, 11)
_LAST = U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.arange(9, dtype=U64)).clip(0, 7))
_LAST[0] = 0


def _trim() -> None:
    """Give freed memory back, as a worker process serves many tasks beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about ``max_bytes`` of text each (one row at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = raw(column)[1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, column.slice(at, end - at)
        at = end
    _trim()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; nulls have no bytes."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several documents: bounds in ``data``, document of each, words before each document."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # n_docs + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(column)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    # a word starts where a text starts or after a space
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:] & before[1:]
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first)


def lanes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each word as little-endian 64-bit numbers, zeros after its end, and the n + 1 bounds of each word's."""
    count = (length + 7) >> 3
    bounds = np.zeros(len(length) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    if len(length) != bounds[-1]:
        word = np.repeat(np.arange(len(length)), count)
        inner = (np.arange(bounds[-1]) - bounds[word]) << 3
        start, length = start[word] + inner, np.minimum(length[word] - inner, 8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    return every[start] & _LAST[length], bounds


def lane_hashes(lane: np.ndarray, bounds: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``lanes``: neighbours are mixed in pairs until one number is left.

    Each pairing is a non-linear function of both sides, so that texts of
    regular structure collide no more than random ones do.
    """
    out = lane[bounds[:-1]] if len(length) else np.zeros(0, U64)
    long = np.flatnonzero(length > 8)
    if len(long):
        count = np.diff(bounds)[long]
        word = np.repeat(np.arange(len(long)), count)
        at = np.cumsum(count) - count
        h = lane[np.arange(len(word)) - at[word] + bounds[long][word]]
        level = 0
        while len(h) > len(long):
            half = (count + 1) >> 1
            to = np.cumsum(half) - half
            word = np.repeat(np.arange(len(long)), half)
            inner = (np.arange(len(word)) - to[word]) << 1
            left = at[word] + inner
            paired = np.flatnonzero(inner + 1 < count[word])
            new = h[left]
            new[paired] = mix(mix(new[paired] ^ _NODE[level]) + h[left[paired] + 1])
            h, count, at, level = new, half, to, level + 1
        out[long] = h
    return mix(out + length.astype(U64) * _NODE[63])


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(w.start):
        return np.zeros(0, U64)
    length = w.end - w.start
    long = np.flatnonzero(length > 8)
    out, _ = lanes(w.data, w.start, np.minimum(length, 8))
    out = mix(out + length.astype(U64) * _NODE[63])
    if len(long):
        out[long] = lane_hashes(*lanes(w.data, w.start[long], length[long]), length[long])
    return out


def windows(h: np.ndarray, w: Words, n: int, seed: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[: len(h) - n + 1] == w.doc[n - 1 :])
    c = constants(n, seed)
    out = h[at] * c[0]
    for j in range(1, n):
        out += h[at + j] * c[j]
    return mix(out), at


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document, sorted in it; documents with
    fewer words give their whole sequence as one.

    Returns the hashes, the document of each and the n_docs + 1 bounds.
    """
    h = word_hashes(w)
    s, at = windows(h, w, n)
    doc = w.doc[at]
    count = w.counts
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        c = constants(n, 22)
        extra = np.zeros(len(short), U64)
        for j in range(n - 1):
            has = count[short] > j
            extra[has] += h[w.first[short][has] + j] * c[j]
        extra = mix(extra + count[short].astype(U64))
        s, doc = np.concatenate([s, extra]), np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[new], doc[new]
    return s, doc, np.searchsorted(doc, np.arange(len(count) + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds (zero for empty runs)."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
