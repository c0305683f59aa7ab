"""Whole columns of texts as numpy byte arrays: words, word hashes and window hashes without a Python object per word.

Hashes are Rabin-Karp polynomials modulo 2**64 taken from prefix sums, so a word's hash costs two
array look-ups however long the word is, followed by a bijective mix that spreads the weak low bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 18

# Odd multipliers of the two independent polynomials and of the mixer.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    size = CHUNK_BYTES + 1
    while size < n:
        size *= 2
    return _powers(base, size)[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


@dataclass
class Words:
    """Words of consecutive rows: byte ranges into ``raw``, and the row each belongs to."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row, its first word; one more at the end

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        n = len(self.raw)
        sums = np.zeros(n + 1, np.uint64)
        power = powers(base, n + 1)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        inverse = powers(pow(base, -1, 1 << 64), n + 1)
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))


def split(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> Words:
    """Maximal runs of word bytes (a boolean array as long as raw); rows never share a word."""
    rows = len(offsets) - 1
    n = len(raw)
    before = np.zeros(n + 1, bool)
    before[1:] = word_byte
    before[offsets[:-1]] = False
    after = np.zeros(n + 1, bool)
    after[:n] = word_byte
    after[offsets[1:]] = False
    start = np.flatnonzero(word_byte & ~before[:n])
    end = np.flatnonzero(word_byte & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    return Words(raw, start, end, np.repeat(np.arange(rows), np.diff(first)), first)


def windows(hashes: np.ndarray, size: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive values (across rows as well: mask those with ``inside``)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(base) + hashes[k : k + n]
    return mix(out)


def inside(row: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` words lie within one row."""
    n = len(row) - size + 1
    return row[:n] == row[size - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive values, by doubling."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:]) if len(out) > width else out[:0]
        width *= 2
    if width < size:
        step = size - width
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
