"""Token ids of words in a hash table of flat arrays: a slice of texts is looked up and put together without a loop over words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .arrays import span_hashes

#: Words a table keeps before it starts anew, unless one slice of texts has more.
WORDS = 1_000_000
#: Words it has room for at first.
FIRST_WORDS = 1 << 15


class WordTable:
    """From the 64-bit hash of a word to its ids. Slots are found by linear probing, all words of a call at once."""

    def __init__(self, kind: str, limit: int = WORDS):
        self.kind, self.limit = kind, limit
        self._clear(min(limit, FIRST_WORDS))

    def _grow(self, room: int):
        """More slots for the words that are there."""
        used = np.flatnonzero(self.keys)
        keys, at, size = self.keys[used], self.at[used], self.size[used]
        pool, filled, count = self.pool, self.used, self.count
        self._clear(room, pool)
        slot = self._place(keys)
        self.at[slot], self.size[slot], self.used, self.count = at, size, filled, count

    def _clear(self, room: int, pool: np.ndarray | None = None):
        slots = 1 << int(2 * room - 1).bit_length()
        self.mask, self.room, self.count, self.used = np.uint64(slots - 1), room, 0, 0
        self.keys, self.at, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.pool = np.zeros(4 * room, self.kind) if pool is None else pool

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        slot, left = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        while len(left):
            key = self.keys[slot[left]]
            hit = key == hashes[left]
            found[left[hit]] = slot[left[hit]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) & int(self.mask)
        return found

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Slots for words that are not there."""
        slot, left = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)
        return self._find(hashes)

    def _add(self, hashes: np.ndarray, ids: list[np.ndarray]):
        slot = self._place(hashes)
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids).astype(self.kind)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.kind)])
        self.pool[self.used:self.used + len(flat)] = flat
        self.at[slot], self.size[slot] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)
        self.count += len(hashes)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[list[bytes]], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the words data[starts:ends] one after the other; `learn` gives the ids of words not met before."""
        hashes = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        slot = self._find(hashes)
        if (slot < 0).any():
            fresh, lead = np.unique(hashes[slot < 0], return_index=True)
            lead = np.flatnonzero(slot < 0)[lead]
            if self.room < self.count + len(fresh) <= self.limit:
                self._grow(min(self.limit, 4 * (self.count + len(fresh))))
            elif self.count + len(fresh) > self.room:
                fresh, lead = np.unique(hashes, return_index=True)
                self._clear(max(self.limit, len(fresh)))
            text = data.tobytes()
            self._add(fresh, learn([text[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist())]))
            slot = self._find(hashes)
        sizes = self.size[slot].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(self.at[slot] - before, sizes) + np.arange(int(sizes.sum()))], sizes


def with_end(ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) per text, closed by the end id; `first` is each text's first word, as `word_bounds` gives it."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])[first] + np.arange(len(first))
    out = np.full(len(ids) + len(first) - 1, end_id, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = ids
    return out, offsets
