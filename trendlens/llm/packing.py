"""Bounded-space online packing of token streams into sequences.

A scan task keeps a fixed number of open windows. A document's tokens (its
text's ids, then the separator) are cut at the window size; the rest goes to
the open window it fits with the least space left. When none has room, the
fullest window takes as much as it can hold -- documents may be cut -- and is
emitted, so emitted windows are full. What is open when the task ends is left
over: at most ``windows`` pieces of sequences per task, written with their ids.

Leftovers are merged by rounds, FAN tasks' leftovers at a time in the same
way, until one group is left: no task ever holds more than FAN x windows
windows, and the last group's open windows end the packing. The last of all
that is not full is cut at powers of two, which need no padding.

The ids are those of the library's ``encode(text, add_special_tokens=False)``:
texts that hold one of the file's added tokens are encoded by the library, all
others by the model on pieces, each met chunk once per worker (``chunk_table``).

Sequence numbers are (round and task) << 32 + a counter. Null texts are empty
(one separator token); rows with equal ids are packed each on its own.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import ChunkTable
from .common import map_arrow, written

WINDOWS = 16   # open windows per task
FAN = 64       # tasks whose leftovers meet in one merge task

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "task int, ids binary")


class Packer:
    """Open windows; ``add`` returns the pieces of windows that it filled."""

    def __init__(self, size: int, windows: int, first_sequence: int) -> None:
        self.size, self.windows, self.next = size, windows, first_sequence
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        """Places a run of ids of one document (``start`` ids come before it, ``total`` in all)."""
        while len(ids):
            if len(ids) >= self.size:
                yield from self.emit([(doc, start, ids[: self.size], total)])
                start, ids = start + self.size, ids[self.size:]
                continue
            best = None
            for i, (used, _) in enumerate(self.open):
                if used + len(ids) <= self.size and (best is None or used > self.open[best][0]):
                    best = i
            if best is None and len(self.open) < self.windows:
                self.open.append((len(ids), [(doc, start, ids, total)]))
                return
            if best is None:  # top up the fullest and emit it; go on with the rest
                best = max(range(len(self.open)), key=lambda i: self.open[i][0])
                room = self.size - self.open[best][0]
            else:
                room = len(ids)
            used, pieces = self.open[best]
            pieces.append((doc, start, ids[:room], total))
            start, ids = start + room, ids[room:]
            if used + room == self.size:
                del self.open[best]
                yield from self.emit(pieces)
            else:
                self.open[best] = (used + room, pieces)

    def emit(self, pieces: list) -> Iterator[tuple]:
        offset, number = 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, number, offset
            offset += len(ids)

    def rest(self) -> list[tuple]:
        return [piece for _, pieces in self.open for piece in pieces]


def _batch(rows: list[tuple], task: int, open_rows: list[tuple] = ()) -> pa.RecordBatch:
    """Emitted pieces (without ids), then pieces left open (with ids, no sequence)."""
    docs, starts, ids, totals, numbers, offsets = zip(*rows) if rows else ((),) * 6
    left = list(zip(*open_rows)) if open_rows else ((),) * 4
    n, m = len(docs), len(left[0])
    raw = [x.astype("<u4").tobytes() for x in (*ids, *left[2])]
    return pa.RecordBatch.from_arrays([
        pa.array([*docs, *left[0]], pa.int64()), pa.array([*starts, *left[1]], pa.int64()),
        pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()),
        pa.array([*totals, *left[3]], pa.int64()), pa.array([*numbers, *[None] * m], pa.int64()),
        pa.array([*offsets, *[None] * m], pa.int64()), pa.array([task] * (n + m), pa.int32()),
        pa.array([*[None] * n, *raw[n:]], pa.binary())],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves,
    the others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def _worker(vocabulary: bytes):
    """Encodes a column of texts; kept in the Python worker between tasks."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_buffer(vocabulary)
    added = [t["content"] for t in json.loads(vocabulary).get("added_tokens") or []]
    # The model itself, on pieces split and written in its letters as its pre-tokeniser does.
    tokenize = tokenizer.model.tokenize
    letters = _byte_letters()

    def encode(pieces: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes()
                for p in pieces]

    table = ChunkTable(encode)

    def of_column(column: pa.Array) -> Iterator[np.ndarray]:
        special = np.zeros(len(column), bool)
        for a in added:
            special |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        if not special.any():
            yield from table.of_column(column)
            return
        plain = pc.if_else(pa.array(special), "", column)
        for text, hit, ids in zip(column, special.tolist(), table.of_column(plain)):
            yield np.array(tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.uint32) if hit else ids

    return of_column


def _pack_texts(vocabulary, size: int, windows: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(size, windows, task << 32)
        encoded = _worker(vocabulary.value)
        rows: list[tuple] = []
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for doc, coded in zip(docs, encoded(batch.column("text").fill_null(""))):
                ids = np.append(coded, np.uint32(separator))
                rows.extend(packer.add(doc, 0, ids, len(ids)))
                if len(rows) >= 4000:
                    yield _batch(rows, task)
                    rows = []
        yield _batch(rows, task, packer.rest())
    return run


def _pack_rest(size: int, windows: int, shift: int, last: bool):
    """Packs the pieces of whole groups of tasks (rows sorted by ``group``)."""
    def close(packer: Packer, group: int) -> pa.RecordBatch:
        if not last:
            return _batch([], group, packer.rest())
        rows = []
        # All open tokens in a row, cut at the size and then at powers of two.
        left, run, room = packer.rest(), [], 0
        total = sum(len(p[2]) for p in left)
        for doc, start, ids, tokens in left:
            while len(ids):
                if not room:
                    room = size if total >= size else 1 << (total.bit_length() - 1)
                    total -= room
                part = ids[:room]
                run.append((doc, start, part, tokens))
                start, ids, room = start + len(part), ids[len(part):], room - len(part)
                if not room:
                    rows.extend(packer.emit(run))
                    run = []
        return _batch(rows, group)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                if r["group"] != group:
                    if packer is not None:
                        yield _batch(rows, group)
                        rows = []
                        yield close(packer, group)
                    group = r["group"]
                    packer = Packer(size, windows, shift + (group << 32))
                rows.extend(packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
            yield _batch(rows, group)
        if packer is not None:
            yield close(packer, group)
    return pack


def pack_documents(docs: DataFrame, vocabulary: bytes, size: int = 1024, separator: int = 0,
                   windows: int = WINDOWS, fan: int = FAN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its document, place there, checksum, sequence and offset there.

    ``vocabulary`` is a tokenizer file's content (about 1.5 MB), broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Written, because the tasks' leftovers go on while their full windows are results.
    pieces = written(map_arrow(plain, _pack_texts(shared, size, windows, separator), PIECES), "packed-0")
    result = pieces.filter("sequence_id IS NOT NULL")
    left = pieces.filter("sequence_id IS NULL")
    tasks = left.agg(F.max("task")).first()[0]
    level = 1
    while tasks is not None:
        tasks //= fan
        groups = left.withColumn("group", F.floor(F.col("task") / fan).cast("int"))
        merge = _pack_rest(size, windows, level << 58, last=tasks == 0)
        groups = groups.repartition("group").sortWithinPartitions("group", "task", "doc_id", "start")
        pieces = written(map_arrow(groups, merge, PIECES), f"packed-{level}")
        result = result.unionByName(pieces.filter("sequence_id IS NOT NULL"))
        left = pieces.filter("sequence_id IS NULL")
        tasks = None if tasks == 0 else tasks
        level += 1
    return result.drop("task", "ids")
