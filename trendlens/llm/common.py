"""Helpers shared by the operators: written tables, Arrow text buffers, word hashes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path

# ASCII white space as the contracts name it: space and tab..carriage return.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
# Bytes of a work slice: bounds the numpy arrays made from one slice (a single
# longer text makes a slice of its own).
SLICE_BYTES = 1 << 20

_U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a new Parquet table in the shared folder, read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and values made from task numbers stay as they were first written.
    """
    path = shared_path(df.sparkSession, "llm", df.sparkSession.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_written(spark: SparkSession) -> bool:
    """Delete this application's written tables; results not yet saved elsewhere can then not be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "llm", spark.sparkContext.applicationId))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors once per application."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_package_sent", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        package = __name__.split(".")[0]
        if os.path.isdir(os.path.join(root, package)):  # else it came as a zip or is installed
            folder = tempfile.mkdtemp(prefix="run-")
            os.makedirs(f"{folder}/tree")
            shutil.copytree(os.path.join(root, package), f"{folder}/tree/{package}",
                            ignore=shutil.ignore_patterns("__pycache__"))
            context.addPyFile(shutil.make_archive(f"{folder}/{package}", "zip", f"{folder}/tree"))
        context._package_sent = True
    return df.mapInArrow(function, schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    cut = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), cut


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``most`` bytes."""
    data, cut = text_buffers(column)
    first, n = 0, len(cut) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(cut, cut[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, data[cut[first]: cut[end]], cut[first: end + 1] - cut[first]
        first = end


def batch_slices(batch: pa.RecordBatch, column: int, most: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text in ``column``: what a task makes of the texts of
    one run (strings, new texts) is freed before the next."""
    for first, end, _, _ in text_slices(batch.column(column), most):
        yield batch.slice(first, end - first)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser), wrapping."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def powers(base: int) -> np.ndarray:
                x = np.full(n, base, _U)
                x[0] = 1
                return np.multiply.accumulate(x)
            if n > 4 * SLICE_BYTES:  # one very long text: not kept
                return powers(_BASE), powers(_INVERSE)
            n = max(n, SLICE_BYTES + 1)
            self.up, self.down = powers(_BASE), powers(_INVERSE)
        return self.up, self.down


_POWERS = _Powers()


@lru_cache(maxsize=None)
def byte_values(fold_ascii: bool) -> np.ndarray:
    """A random 64-bit value per byte; A-Z take those of a-z if ``fold_ascii``."""
    values = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if fold_ascii:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


def byte_class(keep: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(keep, np.uint8)] = True
    return table


def word_bounds(data: np.ndarray, cut: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and ``first``: the words of text i are first[i]:first[i+1].

    Words are runs of bytes for which ``is_word`` holds, cut at the ends of texts.
    """
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = cut[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, cut)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_ascii: bool = True) -> np.ndarray:
    """A 64-bit hash per word: polynomial over random byte values, mixed with the length."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(byte_values(fold_ascii)[data] * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix64(raw ^ ((ends - starts).astype(_U) * _U(0xA0761D6478BD642F)))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each place on (len(words) - k + 1 values; also over ends of texts)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    weights = mix64(np.arange(1, k + 1, dtype=_U) * _U(0xE7037ED1A0B428DB) + _U(seed)) | _U(1)
    total = words[:n] * weights[0]
    for j in range(1, k):
        total = total + words[j: n + j] * weights[j]
    return mix64(total + _U(k))
