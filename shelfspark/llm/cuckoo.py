"""A cuckoo filter over 64-bit keys whose inserts, lookups and deletions are numpy passes.

A key has a 16-bit fingerprint and two buckets of four slots; either bucket follows from the
other and the fingerprint, so a fingerprint can move without its key. Each pass handles one
key a bucket, so that no two write the same slots. A key may be deleted only if it was
inserted, once for each time.
"""

from __future__ import annotations

import numpy as np

from . import textops

SLOTS = 4
#: Passes before an insertion gives up and the caller builds a larger filter.
PASSES = 2000
_SEED = np.uint64(0x5851F42D4C957F2D)


class CuckooFilter:
    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        """Room for ``keys`` keys at a load of at most 0.85, or the given table."""
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (0.85 * SLOTS)))) if keys else 4)
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = textops.mix(keys ^ _SEED)
        prints = (h & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (h >> np.uint64(16)) & self.mask

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (textops.mix(prints.astype(np.uint64)) & self.mask)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def room(self, more: int) -> bool:
        return len(self) + more <= 0.85 * self.table.size

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self._places(keys)
        column = prints[:, None]
        return (self.table[at] == column).any(1) | (self.table[self._other(prints, at)] == column).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert distinct keys; False, with some lost, if no place was found."""
        prints, at = self._places(keys)
        tries = np.zeros(len(keys), np.int32)
        for turn in range(PASSES):
            if not len(prints):
                return True
            _, now = np.unique(at, return_index=True)
            free = self.table[at[now]] == 0
            placed = free.any(1)
            self.table[at[now[placed]], free[placed].argmax(1)] = prints[now[placed]]
            full = now[~placed]
            kick = full[tries[full] > 0]  # both buckets were full: the one here takes a slot from another
            if len(kick):
                slot = (prints[kick].astype(np.int64) + turn) % SLOTS
                victims = self.table[at[kick], slot].copy()
                self.table[at[kick], slot] = prints[kick]
                prints[kick] = victims
            at[full] = self._other(prints[full], at[full])
            tries[full] += 1
            keep = np.ones(len(prints), bool)
            keep[now[placed]] = False
            prints, at, tries = prints[keep], at[keep], tries[keep]
        return not len(prints)

    def delete(self, keys: np.ndarray) -> None:
        prints, at = self._places(keys)
        while len(prints):
            here = (self.table[at] == prints[:, None]).any(1)
            at = np.where(here, at, self._other(prints, at))
            _, now = np.unique(at, return_index=True)
            match = self.table[at[now]] == prints[now][:, None]
            if not match.any(1).all():
                raise ValueError("a key was deleted that had not been inserted")
            self.table[at[now], match.argmax(1)] = 0
            keep = np.ones(len(prints), bool)
            keep[now] = False
            prints, at = prints[keep], at[keep]

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @staticmethod
    def load(raw: bytes) -> CuckooFilter:
        return CuckooFilter(table=np.frombuffer(raw, "<u2").astype(np.uint16).reshape(-1, SLOTS))


def filled(keys: np.ndarray, room: int = 0) -> CuckooFilter:
    """A filter of distinct keys with room for ``room`` more, doubled until all find a place."""
    size = len(keys) + room
    while True:
        out = CuckooFilter(size)
        if out.insert(keys):
            return out
        size = max(16, 2 * size)
