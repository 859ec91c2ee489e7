"""One-permutation MinHash of word-shingle sets, with optimal densification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACE_BYTES, byte_class, gram_hashes, mix64, text_slices, word_bounds, word_hashes

SHINGLE = 5
ROWS, BANDS = 4, 32
BINS = ROWS * BANDS
PROBES = 256       # densification attempts before the next filled bin is taken

_U = np.uint64
_WORD = ~byte_class(SPACE_BYTES)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z folded; fewer than 5 words: all of them as one)."""
    for first, end, data, cut in text_slices(column):
        starts, ends, words = word_bounds(data, cut, _WORD)
        hashes = word_hashes(data, starts, ends)
        grams = gram_hashes(hashes, SHINGLE)
        for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
            n = b - a
            if n >= SHINGLE:
                yield np.unique(grams[a: b - SHINGLE + 1])
            elif n:
                yield gram_hashes(hashes[a:b], n)
            else:
                yield np.zeros(0, _U)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    if not len(shingles):
        return 0, 0
    once = mix64(shingles ^ _U(0x5851F42D4C957F2D))
    return (int(once.sum(dtype=_U).view(np.int64)),
            int(mix64(once).sum(dtype=_U).view(np.int64)))


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """(len(sets), bins) 16-bit values: the least hash of each bin.

    An empty bin takes the value of a filled one that it finds by a probe
    sequence of its own (the same for every set), so two sets agree in it with
    a chance equal to their similarity, independently of other bins.
    """
    # First hash of each bin: bins divide the range of the hash evenly.
    edges = np.array([((k << 32) + bins - 1) // bins << 32 for k in range(bins)], _U)
    least = np.zeros((len(sets), bins), _U)
    filled = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            after = np.append(at[1:], len(s))
            filled[i] = at < after
            least[i] = s[np.minimum(at, len(s) - 1)]
    values = (mix64(least) >> _U(48)).astype(np.uint16)
    rows, empty = np.nonzero(~filled & filled.any(1)[:, None])
    for attempt in range(PROBES + bins):
        if not len(rows):
            break
        if attempt < PROBES:
            probe = (mix64(empty.astype(_U) * _U(PROBES) + _U(attempt + 1)) % _U(bins)).astype(np.int64)
        else:  # hardly ever: very few bins are filled
            probe = (empty + attempt - PROBES + 1) % bins
        hit = filled[rows, probe]
        values[rows[hit], empty[hit]] = values[rows[hit], probe[hit]]
        rows, empty = rows[~hit], empty[~hit]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys: ROWS values and the band's number."""
    rows = np.ascontiguousarray(values, "<u2").view("<u8").reshape(len(values), BANDS)
    return mix64(rows ^ mix64(np.arange(1, BANDS + 1, dtype=_U))).view(np.int64)
