"""Vectorised text kernels over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur inside a multi-byte UTF-8
sequence, so words are found on the raw buffer. Hashes are polynomial over 64-bit wrap-around arithmetic (prefix sums
times an inverse power, so any slice costs O(1)) and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel turns into arrays at a time.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_tables: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, inverse: bool, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (or of its inverse), grown by doubling and kept."""
    have = _tables.get((base, inverse))
    if have is None or len(have) <= n:
        step = pow(base, -1, 1 << 64) if inverse else base
        have, size, top = np.ones(1, U64), 1, max(n + 1, 1 << 16)
        while size < top:
            have = np.concatenate([have, have * U64(pow(step, size, 1 << 64))])
            size *= 2
        _tables[(base, inverse)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salt(k: int) -> np.uint64:
    return U64(((k + 1) * 0xA0761D6478BD642F) & _MASK)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n+1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text stands alone and whole."""
    column = batch.column(text).cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of a few texts: byte range and text of each, and the number of words before each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        solid = ~SPACE[raw]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        self.solid = solid
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.before = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.before)
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.start)) - self.before[self.text]

    def hashes(self, which: int = 0) -> np.ndarray:
        base = _BASES[which]
        n = len(self.raw)
        total = np.zeros(n + 1, U64)
        np.cumsum((self.raw.astype(U64) + U64(1)) * _powers(base, False, n)[:n], out=total[1:])
        value = (total[self.end] - total[self.start]) * _powers(base, True, n)[self.start]
        return mix(value ^ ((self.end - self.start).astype(U64) << U64(48)))

    def grams(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of words that start a k-word window inside their text, and the windows' hashes."""
        at = np.flatnonzero(self.place + k <= self.count[self.text])
        return at, windows(hashes, at, k, which)


def windows(hashes: np.ndarray, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of the k consecutive values that start at each of ``at``."""
    base, n = _BASES[1 - which], len(hashes)
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes * _powers(base, False, n)[:n], out=total[1:])
    return mix((total[at + k] - total[at]) * _powers(base, True, n)[at] + salt(k))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of k places from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:n]) > 0
