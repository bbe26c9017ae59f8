"""Vectorised hashing of byte strings: prefix sums of a polynomial modulo 2**64, so any substring's hash is O(1)."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0..n and its inverses, modulo 2**64; kept between calls up to 512 Ki entries."""
    global _POW, _INV
    if len(_POW) > n:
        return _POW, _INV
    size = 1 << int(n + 1).bit_length()
    tables = []
    for factor in (BASE, pow(BASE, -1, 1 << 64)):
        table = np.full(size, factor, np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=np.uint64))
    if size <= 1 << 19:
        _POW, _INV = tables
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads the low bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """Hashes of substrings of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each data[start:end]; the length takes part."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k bytes in a row."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    if len(x) < width:
        return x[:0]
    w = 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if w < width else x
