"""Texts as chunks that tokenise on their own, with a bounded cache per worker.

The split pattern of the byte-level vocabularies never joins a non-blank
character to a following space, so a text may be cut before every space that
follows one: the ids of the text are the ids of the chunks in order. Texts
with white space before a space are one chunk (their runs of blanks may be
one piece). Frequent chunks are then encoded once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex

CACHE_ENTRIES = 600_000   # kept per worker and kind, half of them from the older generation
LONG_KEY = 200            # longer keys are not kept
SLICE_CHARS = 1 << 20     # texts encoded together

# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLANK_SPACE = re.compile(r"\s ")


def chunks_of(text: str) -> list[str]:
    """``text`` cut before single spaces; joining the chunks gives the text."""
    if not text:
        return []
    if _BLANK_SPACE.search(text) or text[0] == " ":
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


class Generations:
    """Values by key, computed many at a time; keys not met for a generation are forgotten."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES) -> None:
        self.compute, self.half = compute, max(1, entries // 2)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def of(self, keys: set[str]) -> dict[str, bytes]:
        """A dict that holds (at least) the given keys, good until the next call."""
        for key in self.long:
            self.known.pop(key, None)
        if len(self.known) > self.half:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        missing = [key for key in keys if key not in known]
        for key in missing:
            if key in old:
                known[key] = old[key]
        missing = [key for key in missing if key not in known]
        known.update(zip(missing, self.compute(missing)))
        self.long = [key for key in missing if len(key) > LONG_KEY]
        return known


class ChunkCache:
    """Token ids of texts, by chunks, and of new chunks by their pieces.

    ``encode`` gives the ids (as bytes) of each of a list of pieces.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str = PATTERN,
                 entries: int = CACHE_ENTRIES) -> None:
        self.split = regex.compile(pattern).findall
        self.pieces = Generations(encode, entries)
        self.chunks = Generations(self._join, entries)

    def _join(self, chunks: list[str]) -> list[bytes]:
        parts = [self.split(c) for c in chunks]
        get = self.pieces.of({p for x in parts for p in x}).__getitem__
        return [b"".join(map(get, x)) for x in parts]

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The encoded bytes of each text."""
        first = 0
        while first < len(texts):
            end, size = first, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= SLICE_CHARS):
                size += len(texts[end]) + 1
                end += 1
            parts = [chunks_of(t) for t in texts[first:end]]
            get = self.chunks.of({c for p in parts for c in p}).__getitem__
            for p in parts:
                yield b"".join(map(get, p))
            first = end
