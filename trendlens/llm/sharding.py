"""Shards by jump consistent hashing: a stable key and the shard count decide, no ring table.

Going from n to n + 1 shards moves a row only into the new shard (about one
row in n + 1). The law is ``key``: equal texts with different ids may lie in
different shards, and the sizes are even only as far as the hash is.

A row's place in its shard (``slot``) is its place among the shard's rows of
its scan task plus the number of rows of that shard in earlier tasks. The
per-task counts are one row per (task, shard), so no shard's rows are ever
sorted or gathered in one task, whatever key is frequent.

Null ids hash like the empty key and null texts have size 1; rows with equal
ids land in one shard, each with a slot of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, mix64, written

_U = np.uint64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards`` (vectorised jump consistent hash)."""
    state = mix64(keys.astype(_U))
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live]
        state[live] = state[live] * _U(2862933555777941757) + _U(1)
        step = float(1 << 31) / ((state[live] >> _U(33)) + _U(1)).astype(np.float64)
        jump[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


_ROWS = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, task int, place long"


def _place(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            # A null key takes a value of its own that no shift of ids reaches by chance alone.
            keys = np.where(np.asarray(ids.is_null()), _U(0x6E756C6C), keys)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            place += seen[shard]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("size"), batch.column("text_crc32"), pa.array(shard, pa.int32()),
                 pa.array(jump_hash(keys, shards + 1), pa.int32()),
                 pa.array(np.full(len(shard), task, np.int32)), pa.array(place)],
                names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "task", "place"])
    return run


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard, its slot there, and its shard if there were one more."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(body).cast("long") + 1).alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    # Written, because slots join two reads of the same task numbers.
    placed = written(map_arrow(rows, _place(shards), _ROWS), "shards")
    before = (Window.partitionBy("shard").orderBy("task")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
              .select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return (placed.join(starts, ["shard", "task"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("start") + F.col("place")).alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """The documents as Parquet in one folder per shard (column ``shard`` is the folder).

    Files are written where the rows are read, so no shard has to fit one task.
    """
    if "shard" in docs.columns:
        raise ValueError("the input already has a column named shard")
    keyed = docs.select(F.col(id_col).cast("long").alias("key"), F.struct("*").alias("row"))

    def add(batches):
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            keys = np.where(np.asarray(ids.is_null()), _U(0x6E756C6C), keys)
            yield pa.RecordBatch.from_arrays([pa.array(jump_hash(keys, shards), pa.int32()), batch.column(1)],
                                             names=["shard", "row"])

    out = map_arrow(keyed, add, T.StructType().add("shard", T.IntegerType()).add(keyed.schema["row"]))
    out.select("row.*", "shard").write.partitionBy("shard").parquet(path)
