"""A minimal perfect hash over 64-bit keys, built and read in numpy passes, with the keys stored by slot.

Level by level, keys that meet no other in a bit array of twice their number get its bit; the
rest go to the next level. A key's slot is the number of set bits before its own, over all
levels, so n keys fill the slots 0 to n-1. Keys outside the set can land on a slot too:
the stored key there tells them apart.
"""

from __future__ import annotations

import numpy as np

from . import textops

GAMMA = 2
LEVELS = 48


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """``keys`` are distinct."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # cells, bits by 64, slots before each 64
        rest, done = keys, 0
        for level in range(LEVELS):
            if not len(rest):
                break
            cells = -(-GAMMA * len(rest) // 64) * 64
            at = self._at(rest, level, cells)
            met = np.bincount(at, minlength=cells)
            words = np.packbits(met == 1, bitorder="little").view("<u8")
            before = done + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((cells, words, before[:-1]))
            rest, done = rest[met[at] != 1], int(before[-1])
        self.rest = np.sort(rest)  # practically empty: these keep their place in a sorted list
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._place(keys)] = keys

    @staticmethod
    def _at(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (textops.mix(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))) % np.uint64(cells)).astype(np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (cells, words, before) in enumerate(self.levels):
            if not len(todo):
                return out
            at = self._at(keys[todo], level, cells)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = before[at[hit] >> 6] + below[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = len(self.keys) - len(self.rest) + at[same]
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the set: the stored key decides."""
        out = self._place(keys)
        some = np.flatnonzero(out >= 0)
        out[some[self.keys[out[some]] != keys[some]]] = -1
        return out


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    """The sum of equally long arrays, pair by pair."""
    while len(arrays) > 1:
        arrays = [arrays[i] + arrays[i + 1] if i + 1 < len(arrays) else arrays[i] for i in range(0, len(arrays), 2)]
    return arrays[0]
