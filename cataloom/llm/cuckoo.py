"""A cuckoo filter: approximate membership with deletion."""

from __future__ import annotations

import numpy as np

SLOTS, LOAD, MAX_KICKS = 4, 0.8, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """16-bit tags in buckets of four slots. contains() errs for some 8 in 65,536 absent keys and never for present ones."""

    def __init__(self, slots: np.ndarray, held: int = 0):
        self.slots, self.held = slots, held

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, blob: bytes, held: int) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy(), held)

    def dumps(self) -> bytes:
        return self.slots.tobytes()

    def room(self) -> int:
        """Keys that may still be inserted."""
        return max(0, int(self.slots.size * LOAD) - self.held)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        mask = np.uint64(len(self.slots) - 1)
        tags = np.maximum((keys >> np.uint64(48)).astype(np.uint16), np.uint16(1))
        one = keys & mask
        return tags, one.astype(np.int64), (one ^ self._jump(tags, mask)).astype(np.int64)

    @staticmethod
    def _jump(tags: np.ndarray, mask: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((tags.astype(np.uint64) * _MIX) >> np.uint64(20)) & mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tags, one, two = self._places(keys)
        return (self.slots[one] == tags[:, None]).any(1) | (self.slots[two] == tags[:, None]).any(1)

    def _fill(self, tags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put tags where their bucket has room; which of them found none."""
        order = np.argsort(at, kind="stable")
        at_sorted = at[order]
        first = np.r_[True, at_sorted[1:] != at_sorted[:-1]]
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        free = np.argsort(self.slots[at_sorted] != 0, axis=1, kind="stable")  # a bucket's free slots come first
        n_free = (self.slots[at_sorted] == 0).sum(1)
        fits = rank < n_free
        self.slots[at_sorted[fits], free[fits, rank[fits]]] = tags[order][fits]
        left = np.zeros(len(at), bool)
        left[order[~fits]] = True
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """Insert distinct keys; false if one found no place, when the filter must be rebuilt larger."""
        if not len(keys):
            return True
        tags, one, two = self._places(keys)
        left = self._fill(tags, one)
        again = np.flatnonzero(left)
        if len(again):
            still = self._fill(tags[again], two[again])
            for i in again[still]:
                if not self._kick(tags[i], int(two[i])):
                    return False
        self.held += len(keys)
        return True

    def _kick(self, tag: np.uint16, at: int) -> bool:
        mask = np.uint64(len(self.slots) - 1)
        for k in range(MAX_KICKS):
            empty = np.flatnonzero(self.slots[at] == 0)
            if len(empty):
                self.slots[at, empty[0]] = tag
                return True
            slot = k % SLOTS
            tag, self.slots[at, slot] = self.slots[at, slot], tag
            at = int(np.uint64(at) ^ self._jump(np.array([tag], np.uint16), mask)[0])
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that are held."""
        for tag, one, two in zip(*self._places(keys)):
            for at in (one, two):
                hit = np.flatnonzero(self.slots[at] == tag)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    self.held -= 1
                    break
