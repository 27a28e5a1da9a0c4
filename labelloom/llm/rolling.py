"""Prefix polynomial hashes over one buffer of many texts, as numpy operations.

The hash of an item sequence is ``sum(v[x_i] * r**i) mod 2**64`` from prefix sums, brought to
the place 0 with powers of the inverse of ``r`` and mixed. There are pairs of long sequences (from
about 1,024 items) that have equal hashes whatever ``r`` is. Windows here are far shorter; strings of
any length, such as words, take another hash from ``LONG`` on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
LONG = 256
_RADIX = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit integer."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), dtype=np.uint64)
    out[0] = U(1)
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(n - 1, 1 << 18).bit_length())[:n]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))


class PrefixHash:
    """Hashes of any window of a sequence in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(_RADIX, n), out=self.prefix[1:])
        self.back = powers(pow(_RADIX, -1, 1 << 64), n + 1)

    @classmethod
    def of_bytes(cls, data: np.ndarray, seed: int = 0) -> PrefixHash:
        return cls((mix(_BYTE_VALUES + U(seed)) if seed else _BYTE_VALUES)[data])

    def raw(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.back[start]

    def window(self, start: np.ndarray, length) -> np.ndarray:
        return mix(self.raw(start, length))

    def all_windows(self, length: int) -> np.ndarray:
        """Hash of the window at every place that has ``length`` items left."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.prefix[length:] - self.prefix[:n]) * self.back[:n])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of every window of ``width`` values.

    Minima of blocks from either side; the place of a minimum is found by carrying the
    latest place where the running minimum was taken on.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    places = np.arange(blocks * width, dtype=np.int64).reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1)
    took = np.ones_like(grid, dtype=bool)
    took[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(took, places, 0), axis=1)
    flipped = grid[:, ::-1]
    behind = np.minimum.accumulate(flipped, axis=1)
    took = np.ones_like(grid, dtype=bool)
    took[:, 1:] = flipped[:, 1:] <= behind[:, :-1]  # the leftmost of equal ones is met last
    far = blocks * width
    behind_at = np.minimum.accumulate(np.where(took, places[:, ::-1], far), axis=1)[:, ::-1].ravel()
    behind = behind[:, ::-1].ravel()
    ahead, ahead_at = ahead.ravel(), ahead_at.ravel()
    start, end = np.arange(n), np.arange(width - 1, width - 1 + n)
    return np.where(behind[start] <= ahead[end], behind_at[start], ahead_at[end])
