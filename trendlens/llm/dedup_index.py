"""Exact duplicates by an extendible-hash index on shared files.

1. *Entries.* Each scan task compares its texts byte by byte within a bounded
   memory and gives every row the number of the first row with the same text
   (its representative). Entries (key, representative, digest, the row) are
   written to the shared folder. The key is the first ``key_bits`` bits of the
   text's SHA-256.
2. *Directory.* A histogram of the representatives' keys by prefix grows an
   extendible-hash directory: a bucket above its capacity splits by the next
   key bit, doubling the directory where it is the deepest. It holds at most
   2**MAX_DEPTH pointers, so it is small whatever the input; a bucket that is
   overfull at that depth simply stays long (its task streams it).
3. *Owners.* Buckets are key ranges. Owner tasks get whole buckets, sorted by
   key, and stream them: texts of one key are compared byte by byte, different
   ones are chained, and each representative gets the first equal one of its
   chain. Only the different texts of one key are held at a time.
4. Group sizes and the row that stays (largest id) are partial aggregations
   over (class of the representative); rows meet their class through their
   representative, which stands for rows of a single task, so a text that a
   third of all rows share stays spread out.

Nulls: a null text equals the empty text; a null id is smaller than any id.
Rows with equal ids and equal texts are still different rows: the first in
file order stays. Empty tables give empty results. Columns of the input may
have any names: they travel in one struct.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_slices, map_arrow, written

MAX_DEPTH = 16
BUCKET_BYTES = 512 << 10  # capacity of a bucket: texts of its distinct keys
HELD_BYTES = 48 << 20     # texts that a scan task remembers to find its own copies


def _entries(key_bits: int, held_bytes: int):
    """Adds number, representative, key and digest to each row (text first, the rest as it is)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        seen: OrderedDict[bytes, int] = OrderedDict()  # text -> representative, least recently met first
        held = 0
        for batch in (part for whole in batches for part in batch_slices(whole, 0)):
            texts = batch.column(0).fill_null("").cast(pa.binary()).to_pylist()
            numbers = np.arange(number, number + len(texts))
            number += len(texts)
            reps, keys, digests = [], [], []
            for i, text in zip(numbers.tolist(), texts):
                rep = seen.get(text)
                if rep is None:
                    rep = seen[text] = i
                    held += len(text) + 200
                    while held > held_bytes and len(seen) > 1:
                        old, _ = seen.popitem(last=False)
                        held -= len(old) + 200
                else:
                    seen.move_to_end(text)
                digest = hashlib.sha256(text)
                reps.append(rep)
                keys.append(int.from_bytes(digest.digest()[:8], "big") >> (64 - key_bits) << (63 - key_bits))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), pa.array(reps, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests),
                 pa.array(texts, pa.binary()), batch.column(1)],
                names=["number", "rep", "key", "sha", "text", "row"])
    return run


def grow_directory(prefixes: list[tuple[int, int]], capacity: int, depth: int = MAX_DEPTH) -> list[int]:
    """First prefix of each bucket, from (prefix of ``depth`` bits, size) pairs.

    Starts with one bucket of local depth 0 and splits those above the
    capacity by the next bit, down to ``depth`` bits.
    """
    prefixes = sorted(prefixes)
    places = np.array([p for p, _ in prefixes], np.int64)
    total = np.concatenate([[0], np.cumsum([n for _, n in prefixes], dtype=np.int64)])
    done, todo = [], [(0, 0)]  # (first prefix, local depth)
    while todo:
        first, local = todo.pop()
        width = 1 << (depth - local)
        a, b = np.searchsorted(places, [first, first + width])
        if total[b] - total[a] > capacity and local < depth:
            todo += [(first, local + 1), (first + width // 2, local + 1)]
        else:
            done.append(first)
    return sorted(done)


def _bucket_of(starts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(starts, np.int64)
        for batch in batches:
            prefix = batch.column("key").to_numpy() >> (63 - MAX_DEPTH)
            bucket = np.searchsorted(bounds, prefix, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns],
                                             names=["bucket", *batch.schema.names])
    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the first representative with the same bytes under the same key."""
    key, chain = None, {}
    for batch in batches:
        reps, firsts = batch.column("rep").to_pylist(), []
        for k, rep, text in zip(batch.column("key").to_pylist(), reps, batch.column("text").to_pylist()):
            if k != key:
                key, chain = k, {}
            firsts.append(chain.setdefault(text, rep))
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(firsts, pa.int64())],
                                         names=["rep", "first"])


def index_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: bool = False,
                     key_bits: int = 60, capacity: int = BUCKET_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256.

    With ``carry`` the input row is also returned, as the struct column
    ``row`` with all its columns. Small ``key_bits`` force collisions.
    """
    if not 1 <= key_bits <= 62:
        raise ValueError("key_bits must be 1 to 62")
    others = [c for c in docs.columns if c != text] if carry else []
    source = docs.select(
        F.col(text).cast("string").alias("text"),
        F.struct(F.col(id_col).alias("doc_id"), F.col(text).isNull().alias("was_null"),
                 *([F.struct(*others).alias("others")] if others else [])).alias("row"))
    kind = (T.StructType().add("number", T.LongType()).add("rep", T.LongType()).add("key", T.LongType())
            .add("sha", T.StringType()).add("text", T.BinaryType()).add(source.schema["row"]))
    entries = written(map_arrow(source, _entries(key_bits, held_bytes), kind), "dedup-entries")

    reps = entries.filter("number = rep")
    sizes = (reps.groupBy("key").agg(F.max(F.octet_length("text")).alias("n"))
             .groupBy(F.shiftright("key", 63 - MAX_DEPTH).alias("prefix")).agg(F.sum(F.col("n") + 64).alias("n")))
    starts = grow_directory([(r.prefix, r.n) for r in sizes.collect()], capacity)  # at most 2**MAX_DEPTH rows

    buckets = map_arrow(
        reps.select("key", "rep", "text"), _bucket_of(starts), "bucket int, key long, rep long, text binary")
    owned = buckets.repartition("bucket").sortWithinPartitions("bucket", "key", "rep")
    firsts = map_arrow(owned, _chain, "rep long, first long").checkpoint()

    # (largest id, first row) and count: first by representative (rows of one task), then by class.
    ident = F.struct(F.col("row.doc_id").alias("doc_id"), (-F.col("number")).alias("order"))
    local = entries.groupBy("rep").agg(F.max(ident).alias("top"), F.count("*").alias("n"))
    of_rep = local.join(firsts, "rep").select("rep", "first", "top", "n").checkpoint()
    classes = of_rep.groupBy("first").agg(F.max("top").alias("top"), F.sum("n").alias("n")).checkpoint()
    groups = of_rep.select("rep", "first").join(classes, "first").select("rep", "top", "n")
    columns = ["number", "rep", "sha", "row"] + (["text"] if carry else [])
    body = F.when(~F.col("row.was_null"), F.col("text").cast("string"))
    carried = F.struct(*(body.alias(c) if c == text else F.col(f"row.others.`{c}`").alias(c) for c in docs.columns))
    return (entries.select(*columns).join(groups, "rep")
            .select(F.col("row.doc_id").alias("doc_id"), F.col("top.doc_id").alias("keep_id"),
                    F.col("n").alias("group_size"),
                    (F.col("top.order") == -F.col("number")).alias("kept"), F.col("sha").alias("text_sha256"),
                    *([carried.alias("row")] if carry else [])))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, all columns as they are."""
    kept = index_duplicates(docs, id_col, text, carry=True).filter("kept")
    return kept.select("row.*")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
