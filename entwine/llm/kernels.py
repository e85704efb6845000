"""Vectorised text kernels shared by the operators.

Every kernel works on the UTF-8 bytes of many documents at once, cut into slices of a
bounded number of bytes, so a batch never needs more than a few tens of megabytes.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of those bytes are
ASCII, so splitting on bytes is the same as splitting on characters.

Hashes are 64-bit polynomial sums modulo 2**64 over tabulated random values, finished by
a mixing step.  They depend only on the input and on the fixed seed below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_GRAM = int(_RNG.integers(1, 2**62)) * 2 + 1
_M64 = (1 << 64) - 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(1, dtype=np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of values[first:last] for every pair of bounds."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of consecutive documents: byte bounds, first word of each document (n + 1 entries), hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the n-word windows that lie within one document."""
        counts = np.diff(self.first)
        ok = np.repeat(self.first[1:], counts) - np.arange(len(self.start)) >= n
        at = np.flatnonzero(ok)
        return at, runs(self.hash, at, at + n, _GRAM)


def split_words(data: np.ndarray, bounds: np.ndarray, hashes: bool = True, inside: np.ndarray | None = None, cuts: np.ndarray | None = None) -> Words:
    """Words of the documents data[bounds[i]:bounds[i + 1]]; ``inside`` marks the bytes of words, ``cuts`` places where words end besides."""
    n = len(data)
    inside = ~SPACE[data] if inside is None else inside
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    if cuts is not None:
        cut[cuts] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | cut[:-1]))
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, bounds), runs(_BYTE[data], start, end, _BASE) if hashes else None)


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, bounds) of successive slices of a string column.

    A slice holds ``most`` bytes, or one document if that is longer.  Null is an empty text.
    """
    for chunk, base in _chunks(column):
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        n = len(chunk)
        if not n:
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("" if pa.types.is_string(chunk.type) or pa.types.is_large_string(chunk.type) else b"")
        raw = chunk.buffers()
        offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
            yield base + i, base + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def _chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    at = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield chunk, at
        at += len(chunk)


def sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """op over x[i:i + w] for every whole window, by doubling."""
    have, size = x, 1
    while size * 2 <= w:
        have = op(have[: len(have) - size], have[size:])
        size *= 2
    rest = w - size
    return op(have[: len(have) - rest], have[rest:]) if rest else have


def sums_between(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of x[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(x) + 1, dtype=np.float64 if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
