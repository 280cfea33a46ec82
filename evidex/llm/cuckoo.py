"""Cuckoo filters of 64-bit keys in numpy: sets with deletion that may hold false positives only."""

from __future__ import annotations

import numpy as np

from ._words import mix

SLOTS, LOAD, KICKS = 4, 0.85, 400


class Cuckoo:
    """Buckets of four 16-bit marks; a key has two buckets, each the other's under its mark."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
            table = np.zeros((n, SLOTS), np.uint16)
        self.table = table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (h & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds distinct keys that are not in the filter; False if they don't fit (then it is to be made anew, larger)."""
        mark, at = self._places(keys)
        for turn in range(KICKS):
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = (self.table[at] == 0).cumsum(1)
            fits = rank < free[:, -1]
            slot = (free[fits] == rank[fits, None] + 1).argmax(1)
            self.table[at[fits], slot] = mark[fits]
            mark, at = mark[~fits], at[~fits]
            if not len(mark):
                return True
            if turn == 0:
                at = self._other(mark, at)
                continue
            # One of each full bucket's waiting marks takes the place of another, which goes on.
            _, first = np.unique(at, return_index=True)
            slot = (mix(np.arange(len(first), dtype=np.uint64) + np.uint64(turn * 7919)) & np.uint64(SLOTS - 1)).astype(np.int64)
            out = self.table[at[first], slot].copy()
            self.table[at[first], slot] = mark[first]
            mark[first] = out
            at = self._other(mark, at) if turn % 2 else np.concatenate((self._other(mark[first], at[first]), np.delete(at, first)))
            if not turn % 2:
                mark = np.concatenate((mark[first], np.delete(mark, first)))
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._places(keys)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[self._other(mark, at)] == mark[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one mark for each key; every key must be in the filter."""
        for mark, at in zip(*self._places(keys), strict=True):
            for bucket in (at, self._other(np.array([mark]), np.array([at]))[0]):
                slot = np.flatnonzero(self.table[bucket] == mark)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


def build(keys: np.ndarray) -> Cuckoo:
    """Filter of the keys; equal ones count once, so that a table large enough is always found."""
    keys = np.unique(keys)
    capacity = len(keys)
    while not (f := Cuckoo(capacity)).insert(keys):
        capacity *= 2
    return f
