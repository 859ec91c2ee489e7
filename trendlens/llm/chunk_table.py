"""Token ids of whole Arrow slices: chunks are hashed and looked up together.

A slice of texts is cut into the chunks of ``chunks``, without making strings of them: a
chunk begins at each space and at each text. Their 64-bit hashes are looked up in an
open-addressed table, all at once; only chunks that the table lacks are made
strings and encoded (by pieces, see ``chunks``). Ids lie in one pool, so those of a
slice are one gather. When the table or the pool is full both are emptied.

Texts with white space before a space, which are one chunk each, are encoded one by one. Two
different chunks of a worker share a hash with a chance of some 1e-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .chunks import PATTERN, ChunkCache, _BLANK_SPACE
from .common import text_slices, word_hashes

ENTRIES = 1 << 19        # chunks kept per worker
POOL_IDS = 1 << 23       # ids kept per worker
PIECES = 1 << 16         # pieces kept per worker; those of chunks that the table holds are not asked for again
TABLE_SLICE = 1 << 18    # bytes of text looked up together; the arrays made for them take some 60 times that

_U = np.uint64
_NONE = _U(0)            # an empty slot; a hash of 0 counts as 1


class ChunkTable:
    """``encode`` gives the ids (as bytes) of each of a list of pieces."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str = PATTERN, entries: int = ENTRIES,
                 pool_ids: int = POOL_IDS) -> None:
        self.cache = ChunkCache(encode, pattern, PIECES)
        self.entries, self.pool_ids = entries, pool_ids
        self.mask = _U(4 * entries - 1)
        assert entries & (entries - 1) == 0
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(4 * self.entries, _U)
        self.entry = np.zeros(4 * self.entries, np.int32)
        self.starts, self.sizes = np.zeros(self.entries, np.int64), np.zeros(self.entries, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.known = self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        live, slot = np.arange(len(hashes)), hashes & self.mask
        while len(live):
            there = self.keys[slot]
            hit = there == hashes[live]
            out[live[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != _NONE)
            live, slot = live[on], (slot[on] + _U(1)) & self.mask
        return out

    def _put(self, hashes: np.ndarray, coded: list[bytes]) -> None:
        """New, distinct hashes and the ids of their chunks."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        a, b = self.known, self.known + len(hashes)
        self.pool[self.used: self.used + len(ids)] = ids
        self.starts[a:b], self.sizes[a:b] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.known = self.used + len(ids), b
        live, slot = np.arange(len(hashes)), hashes & self.mask
        while len(live):
            empty = self.keys[slot] == _NONE
            self.keys[slot[empty]] = hashes[live[empty]]  # of several for one slot, one stays
            mine = empty & (self.keys[slot] == hashes[live])
            self.entry[slot[mine]] = a + live[mine]
            live, slot = live[~mine], (slot[~mine] + _U(1)) & self.mask

    def _entries_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Entries of the chunks, those that were missing put in; None if there are more than the table holds."""
        hashes = np.maximum(word_hashes(data, starts, ends, False), _U(1))
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        if self.known + len(new) > self.entries or self.used > self.pool_ids:
            if len(new) > self.entries or not self.known:
                return None
            self._clear()
            return self._entries_of(data, starts, ends)
        at = missing[first]
        raw = data.tobytes()
        chunks = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        a = self.known
        self._put(new, self.cache._join(chunks))
        found[missing] = a + which
        return found

    def of_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none)."""
        for first, end, data, cut in text_slices(column, TABLE_SLICE):
            texts = column.slice(first, end - first).to_pylist()
            slow = np.array([bool(t) and (t[0] == " " or _BLANK_SPACE.search(t) is not None) for t in texts])
            begins = data == 0x20
            begins[cut[:-1][cut[:-1] < cut[1:]]] = True
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(data))
            if slow.any():
                fast = ~slow[np.searchsorted(cut, starts, "right") - 1]
                starts, ends = starts[fast], ends[fast]
            entries = self._entries_of(data, starts, ends)
            if entries is None:  # more different chunks than the table holds: without it
                yield from (np.frombuffer(x, "<u4") for x in self.cache.of_texts([t or "" for t in texts]))
                continue
            sizes = self.sizes[entries]
            upto = np.append(0, np.cumsum(sizes))
            ids = self.pool[np.repeat(self.starts[entries] - upto[:-1], sizes) + np.arange(upto[-1])]
            bounds = upto[np.searchsorted(starts, cut)].tolist()
            for text, is_slow, a, b in zip(texts, slow.tolist(), bounds, bounds[1:]):
                yield np.frombuffer(next(self.cache.of_texts([text])), "<u4") if is_slow else ids[a:b]
