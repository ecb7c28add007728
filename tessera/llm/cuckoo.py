"""A cuckoo filter over 64-bit keys: 16-bit fingerprints, four slots a bucket, insert, delete, bulk lookup."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
_MIX = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _parts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = keys.astype(np.uint64)
    mark = (keys >> np.uint64(48)).astype(np.uint64)
    mark[mark == 0] = 1
    first = keys & np.uint64(buckets - 1)
    with np.errstate(over="ignore"):
        second = first ^ (((mark * np.uint64(_MIX)) >> np.uint64(20)) & np.uint64(buckets - 1))
    return mark.astype(np.uint16), first.astype(np.int64), second.astype(np.int64)


class CuckooFilter:
    """Sized for ``capacity`` keys at a load of at most 0.8; ``insert`` is False when it is full."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1
        while buckets * SLOTS * 0.8 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self._random = np.random.default_rng(len(self.table))

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def insert(self, keys: np.ndarray) -> bool:
        table = self.table
        for mark, first, second in zip(*_parts(keys, len(table)), strict=True):
            at = int(first)
            for bucket in (int(first), int(second)):
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = mark
                    break
            else:
                for _ in range(KICKS):
                    slot = int(self._random.integers(SLOTS))
                    mark, table[at, slot] = table[at, slot], mark
                    at ^= (((int(mark) * _MIX) & _WORD) >> 20) & (len(table) - 1)
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        for mark, first, second in zip(*_parts(keys, len(self.table)), strict=True):
            for bucket in (int(first), int(second)):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = _parts(keys, len(self.table))
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)
