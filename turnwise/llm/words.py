"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Everything here
works on slices of a few megabytes of text, so memory does not depend on how
many rows a batch has; one row is never split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_C1 = np.uint64(0xFF51AFD7ED558CCD)
_C2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _S)
    x = x * _C1
    x = x ^ (x >> _S)
    x = x * _C2
    return x ^ (x >> _S)


@dataclass
class Words:
    """The words of consecutive rows: row r has words first[r]:first[r + 1] and bytes from offset[r]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.start)
        size = (self.end - self.start).astype(np.int64)
        out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        if not n:
            return out
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded.data, 0, (1,))
        rows, at, left = None, self.start, size
        while True:
            part = eight[at]
            short = np.minimum(left, 8).astype(np.uint64)
            part = part & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
            if rows is None:
                out = mix(out ^ part)
            else:
                out[rows] = mix(out[rows] * _C2 + part)
            more = left > 8
            if not more.any():
                return out
            rows = np.nonzero(more)[0] if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8


def split_words(texts: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Words:
    """Words of a string array; a null row has none. ``table`` replaces each byte first."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8).copy() if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    table = _LOWER if lower and table is None else table
    data = data if table is None else table[data]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    start = np.nonzero(word & (~before | edge[:-1]))[0]
    end = np.nonzero(word & (~after | edge[1:]))[0] + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def windows(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = np.uint64(base | 1)
    out = h[:n].copy()
    for j in range(1, width):
        out *= b
        out += h[j : j + n]
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
