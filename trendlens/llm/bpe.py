"""Byte-level BPE encoding and decoding by a tournament tree over byte positions.

A piece (one match of the split pattern) starts as one token per byte. A
segment tree over the byte positions holds, per live token, the rank of the
pair it forms with its right neighbour (ranks are ids: the pair's rank is the
id of the joined token); the root is the leftmost minimum. A merge takes the
root, joins the two tokens, and makes three point updates of log2(n) steps:
the joined token, its left neighbour, and the token that is gone.

Short pieces of a slice of texts are merged in lockstep, one numpy row each;
long ones one by one. Both take n log n steps for n bytes, whatever the text.

Each row is encoded where it is read: no shuffle, nothing to skew. Null texts
are empty (no tokens). Pieces that are whole tokens are that token, as in the
rank-file library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import map_arrow

_NONE = np.int64(1) << 62
_SHIFT = 32
LONG_PIECE = 64  # bytes; longer ones are merged one by one


class Vocabulary:
    """Tokens by id, and the id of the token that two tokens join to."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        pairs = (line.split() for line in ranks_file.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, joined = [], []
        get = self.ranks.get
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << _SHIFT | b)
                    joined.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ids = np.array(joined, np.int64)[order]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of left + right per pair, or a value above all ids (also where either is below 0)."""
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ids[at], _NONE)

    def join_one(self, left: int, right: int) -> int:
        key = left << _SHIFT | right
        at = int(np.searchsorted(self.pair_keys, key))
        return int(self.pair_ids[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else -1

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = np.array(merge_one(self, piece), "<u4").tobytes()
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for leaves, members in groups.items():
            for a in range(0, len(members), 8192):
                part = members[a: a + 8192]
                for i, ids in zip(part, merge_many(self, [pieces[i] for i in part], leaves)):
                    out[i] = ids
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: its pieces' ids in order, different pieces encoded once."""
        split = [self.pattern.findall(t) for t in texts]
        different = list({p for s in split for p in s})
        ids = dict(zip(different, self.encode_pieces([p.encode() for p in different])))
        return [b"".join(map(ids.__getitem__, s)) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def merge_many(vocabulary: Vocabulary, pieces: list[bytes], leaves: int) -> list[bytes]:
    """Merges pieces of at most ``leaves`` bytes (a power of two) in lockstep, a tree per row."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
    inside = np.arange(leaves) < lengths[:, None]
    # Positions leaves (right end) and leaves + 1 (left end) are no tokens.
    token = np.full((n, leaves + 2), -1, np.int64)
    token[:, :leaves][inside] = vocabulary.byte_ids[raw[inside]]
    following = np.minimum(np.arange(1, leaves + 1), lengths[:, None])
    following = np.where(following >= lengths[:, None], leaves, following)
    before = np.tile(np.arange(-1, leaves + 1), (n, 1))
    before[:, 0] = leaves + 1
    place = np.arange(leaves)
    tree = np.full((n, 2 * leaves), _NONE, np.int64)

    def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank == _NONE, _NONE, rank << _SHIFT | at)

    tree[:, leaves:] = leaf(vocabulary.join(token[:, :leaves], np.take_along_axis(token, following, 1)), place)
    node = leaves
    while node > 1:
        tree[:, node // 2: node] = np.minimum(tree[:, node: 2 * node: 2], tree[:, node + 1: 2 * node: 2])
        node //= 2

    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        best = tree[live, 1]
        rank, i = best >> _SHIFT, best & ((1 << _SHIFT) - 1)
        gone = following[live, i]
        after = following[live, gone]
        left = before[live, i]
        token[live, i] = rank
        token[live, gone] = -1
        following[live, i] = after
        inner = after < leaves
        before[live[inner], after[inner]] = i[inner]
        tree[live, leaves + gone] = _NONE
        tree[live, leaves + i] = leaf(vocabulary.join(rank, token[live, after]), i)
        has = left < leaves
        rows, l = live[has], left[has]
        tree[rows, leaves + l] = leaf(vocabulary.join(token[rows, l], rank[has]), l)
        for rows, at in ((live, gone), (live, i), (rows, l)):
            node = (leaves + at) // 2
            for _ in range(leaves.bit_length() - 1):
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node //= 2
        live = live[tree[live, 1] != _NONE]
    body = token[:, :leaves]
    kept = body >= 0
    ids = body[kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(1) * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def merge_one(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """The same for one piece of any length."""
    n = len(piece)
    leaves = 1 << max(0, (n - 1).bit_length())
    none = int(_NONE)
    first = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)]
    token = first.tolist()
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = vocabulary.join(first[:-1], first[1:])
    level = np.full(leaves, none, np.int64)
    level[: n - 1] = np.where(ranks == _NONE, none, ranks << _SHIFT | np.arange(n - 1))
    levels = [level]
    while len(level) > 1:
        level = np.minimum(level[::2], level[1::2])
        levels.append(level)
    tree = [none] + np.concatenate(levels[::-1]).tolist()
    known: dict[tuple[int, int], int] = {}

    def put(at: int, right: int) -> None:
        value = none
        if right < n:
            pair = token[at], token[right]
            rank = known.get(pair)
            if rank is None:
                rank = known[pair] = vocabulary.join_one(*pair)
            if rank >= 0:
                value = rank << _SHIFT | at
        set_leaf(at, value)

    def set_leaf(at: int, value: int) -> None:
        node = leaves + at
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
            node >>= 1

    while tree[1] != none:
        rank, i = tree[1] >> _SHIFT, tree[1] & ((1 << _SHIFT) - 1)
        gone = following[i]
        after = following[gone]
        token[i], token[gone] = rank, -1
        following[i] = after
        if after < n:
            before[after] = i
        set_leaf(gone, none)
        put(i, after)
        if before[i] >= 0:
            put(before[i], i)
    return [t for t in token if t >= 0]


@lru_cache(maxsize=2)
def _worker(ranks_file: bytes, pattern: str) -> tuple[Vocabulary, ChunkCache, list[str]]:
    """Kept in the Python worker between tasks."""
    vocabulary = Vocabulary(ranks_file, pattern)
    def encode(pieces: list[str]) -> list[bytes]:
        return vocabulary.encode_pieces([p.encode() for p in pieces])

    return vocabulary, ChunkCache(encode, pattern), [str(i) for i in range(len(vocabulary.tokens))]


def read_file(path: str) -> bytes:
    """The vocabulary file's bytes; read by the driver, so executors need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Ids of every text and the round trip: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    ``ranks_file`` is a vocabulary (under 1 MB here), broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache, decimal = _worker(shared.value, pattern)
        for batch in batches:
            counts, id_sums, text_sums, all_ids = [], [], [], []
            for coded in cache.of_texts(batch.column("text").fill_null("").to_pylist()):
                ids = np.frombuffer(coded, "<u4").tolist()
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sums.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()),
                       pa.array(text_sums, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(plain, run, fields)


def decode_documents(coded: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id",
                     ids: str = "ids") -> DataFrame:
    """Texts from id lists: doc_id, text (null ids give an empty text; bytes that are no UTF-8 are replaced)."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _, _ = _worker(shared.value, pattern)
        for batch in batches:
            texts = [vocabulary.decode(x or []).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    plain = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return map_arrow(plain, run, "doc_id long, text string")
