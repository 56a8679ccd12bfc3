"""Cuckoo filters over 128-bit keys given as two integer columns."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500


class CuckooFilter:
    """Approximate set with deletion: no key that was added is missed.

    A key has a 16-bit fingerprint in one of two buckets; either bucket leads to the other by
    the fingerprint. Adding a key twice needs deleting it twice, so callers keep exact counts.
    """

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    def _marks(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (low.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (high.view(np.uint64) & mask).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        mixed = (np.uint64(0x9E3779B97F4A7C15) * np.asarray(mark, np.uint64)) >> np.uint64(32)
        return bucket ^ (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        mark, one, two = self._marks(high, low)
        mark = mark[:, None]
        return (self.table[one] == mark).any(axis=1) | (self.table[two] == mark).any(axis=1)

    def add(self, high: np.ndarray, low: np.ndarray) -> bool:
        """False when the filter is too full; it then has to be built anew, larger."""
        order = np.random.default_rng(len(high))
        for mark, one, two in zip(*self._marks(high, low)):
            if not (self._put(one, mark) or self._put(two, mark)):
                bucket = one if order.integers(2) else two
                for _ in range(KICKS):
                    slot = order.integers(SLOTS)
                    mark, self.table[bucket, slot] = self.table[bucket, slot], mark
                    bucket = int(self._other(np.int64(bucket), mark))
                    if self._put(bucket, mark):
                        break
                else:
                    return False
        return True

    def _put(self, bucket: int, mark) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return bool(len(free))

    def remove(self, high: np.ndarray, low: np.ndarray) -> None:
        """Only keys that were added may be removed."""
        for mark, one, two in zip(*self._marks(high, low)):
            for bucket in (one, two):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())
