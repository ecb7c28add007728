"""Words as 64-bit hashes, with a bounded memo in each Python worker."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
MEMO = 200_000
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Memo(dict):
    """A dict that fills itself by ``make`` and is emptied when it has ``limit`` entries."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_hashes = Memo(xxhash.xxh3_64_intdigest)


def word_hashes(words: list) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * K2
    return h ^ (h >> np.uint64(29))
