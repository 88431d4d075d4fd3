"""A cuckoo filter over 128-bit keys: four slots a bucket, 32-bit fingerprints, deletions allowed."""

from __future__ import annotations

import numpy as np

from plumbspark.llm.blocks import mix

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Keys are pairs of unsigned 64-bit halves; ``high`` gives the fingerprint, ``low`` the bucket."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def sized_for(cls, keys: int, load: float = 0.7) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * load))))))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, "<u4").reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u4").tobytes()

    def _places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (high & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        mark[mark == 0] = 1  # 0 is an empty slot
        first = mix(low) & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return bucket ^ (mix(np.asarray(mark, np.uint64)) & self.mask)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(high, low)
        return (self.table[first] == mark[:, None]).any(axis=1) | (self.table[second] == mark[:, None]).any(axis=1)

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """False if the filter is full; it must then be built anew, larger."""
        for mark, first, second in zip(*self._places(high, low)):
            for bucket in (first, second):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket = second
                for kick in range(KICKS):
                    slot = kick % SLOTS
                    mark, self.table[bucket, slot] = self.table[bucket, slot], mark
                    bucket = self._other(bucket, mark)
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Only keys that were inserted may be deleted: the callers know them from the exact counts."""
        for mark, first, second in zip(*self._places(high, low)):
            for bucket in (first, second):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
            else:
                raise KeyError("the filter doesn't hold this key")
