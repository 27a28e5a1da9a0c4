"""Sort of suffixes by hash-compared mergesort.

Two suffixes are compared by the length of their common extension, found by binary search
over prefix polynomial hashes, and then by one byte: a comparison takes the logarithm of the
depth. All merges of a level run side by side as numpy operations, each suffix finding its
place in the other run by binary search. What comes out as equal is verified on its bytes.
"""

from __future__ import annotations

import numpy as np

from labelloom.llm.rolling import PrefixHash


class Suffixes:
    """Suffixes of ``data`` that start at ``starts``, compared to ``depth`` bytes; all have as many left."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, depth: int):
        self.data, self.starts, self.depth = data, starts, depth
        self.hashes = PrefixHash.of_bytes(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``i`` and ``j``, up to the depth."""
        a, b = self.starts[i], self.starts[j]
        lo, hi = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.depth)
        for _ in range(int(self.depth).bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.hashes.raw(a, mid) == self.hashes.raw(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix ``i`` comes before ``j``; equal ones count if ``or_equal``."""
        n = self.common(i, j)
        at = np.minimum(n, self.depth - 1)
        x, y = self.data[self.starts[i] + at], self.data[self.starts[j] + at]
        return np.where(n >= self.depth, or_equal, x < y)

    def sort(self, bucket: np.ndarray) -> np.ndarray:
        """A stable order of the suffixes within each bucket; buckets are contiguous."""
        total = len(bucket)
        order = np.arange(total)
        first = np.searchsorted(bucket, bucket, side="left")  # where the bucket of each place begins
        last = np.searchsorted(bucket, bucket, side="right")
        width, widest = 1, int((last - first).max(initial=0))
        place = np.arange(total)
        while width < widest:
            in_run = (place - first) // width
            left = in_run % 2 == 0
            mine = first + in_run * width
            other = np.where(left, mine + width, mine - width)
            size = np.where(other < last, np.minimum(other + width, last) - other, 0)
            active = np.flatnonzero(size > 0)
            rank = self._ranks(order, active, other[active], size[active], left[active])
            target = place.copy()
            base = np.where(left[active], mine[active], other[active])
            target[active] = base + (active - mine[active]) + rank
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order

    def _ranks(self, order, who, other, size, left) -> np.ndarray:
        """How many suffixes of the other run come before each of ``who``; a tie goes to the left run."""
        lo, hi = np.zeros(len(who), dtype=np.int64), size.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            them, me = order[other[open_] + mid], order[who[open_]]
            is_left = left[open_]
            before = np.where(is_left, self.less(them, me, False), self.less(them, me, True))
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)

    def equal_to_previous(self, order: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Whether each suffix of a sorted order equals the one before it, verified on the bytes."""
        same = np.zeros(len(order), dtype=bool)
        if len(order) > 1:
            at = np.flatnonzero(bucket[order[1:]] == bucket[order[:-1]])
            at = at[self.common(order[at + 1], order[at]) >= self.depth]
            for block in np.array_split(at, max(1, len(at) // 10_000)):
                cells = np.arange(self.depth)
                a, b = self.starts[order[block + 1]][:, None] + cells, self.starts[order[block]][:, None] + cells
                same[block + 1] = (self.data[a] == self.data[b]).all(axis=1)
        return same
