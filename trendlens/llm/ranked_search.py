"""Ranked lexical search: accumulators of short lists as one iterator among skipping long lists.

*Index.* ``build_index`` reads every row and whole text once. A task cuts its
rows into segments of about SEGMENT_TERMS terms and writes one row per
segment: document ids and lengths, and per term (a 64-bit hash) the sorted
places of its documents with their occurrences. No shuffle.

*Search.* ``search`` takes items in blocks of at most BLOCK_TERMS terms (a
longer text makes a block of its own), so what is broadcast is bounded. For a
block, document frequencies are summed over all segments; then each task
goes through its segments, item by item:

1. Term at a time: the shortest lists are added up in accumulators. From here
   on these are one iterator with one bound, the largest accumulated score.
2. Document at a time: that iterator and the long lists, ordered by bound,
   are walked in windows of ascending places. Lists whose bounds together stay
   below the k-th best score so far lead to no document of their own; they are
   only probed at the places that can still reach that score.

The k best per item are kept over all segments of a task, so its threshold only
rises; tasks' lists are merged in two steps (MERGE_GROUPS groups per item first).

Scores are 64-bit integers: a term weighs ``floor(1000 * ln((2N+2)/(2df+1)))``
and adds ``weight * ((10^9 tf) div (1000 tf + 12 m))`` with
``m = 75 + (25 n N) div L``.

Null texts and items, or ones without a term, take part in nothing. Items are
distinct (id, text) rows; documents are rows, so repeated rows rank side by side.
Equal scores are ordered by document id, null ids last. An empty table of
documents or items gives no row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_class, map_arrow, text_slices, word_bounds, word_hashes, written

SEGMENT_TERMS = 2_000_000   # terms of a segment (a longer text is a segment of its own)
SEGMENT_DOCS = 1 << 17
BLOCK_TERMS = 200_000       # distinct item terms broadcast at a time
TERM_BYTES = 6              # text per item term, for the number of tasks that make blocks
SHORT_SHARE = 2             # short lists: together at most 1/2 of the segment's documents
WINDOW = 4096               # places per window of the walk over long lists
MERGE_GROUPS = 64

# [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: ASCII letters, digits and all bytes of other characters.
TERM = byte_class(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))

_INDEX = ("segment long, n_docs long, n_terms long, ids binary, no_id binary, lengths binary, "
          "terms binary, starts binary, places binary, times binary")
_HITS = "item int, doc_id long, score long"


def text_terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, term hashes, first term of each row and the end) for runs of whole texts."""
    for first, end, data, cut in text_slices(column):
        starts, ends, words = word_bounds(data, cut, TERM)
        yield first, end, word_hashes(data, starts, ends), words


def _posting_lists(hashes: np.ndarray, place: np.ndarray) -> tuple:
    """Distinct terms, where their lists start, and (places, times); ``place`` ascends."""
    order = np.argsort(hashes, kind="stable")
    hashes, place = hashes[order], place[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(hashes)))
    hashes, place = hashes[at], place[at]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    starts = np.flatnonzero(first)
    return hashes[starts], np.append(starts, len(hashes)), place, times


def _segments(segment_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        ids, absent, lengths, hashes, places = [], [], [], [], []
        docs = terms = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, absent, lengths, hashes, places, docs, terms, segment
            n = np.concatenate(lengths)
            found, starts, place, times = _posting_lists(np.concatenate(hashes), np.concatenate(places))
            columns = [(np.concatenate(ids), "<i8"), (np.concatenate(absent), "u1"), (n, "<i8"), (found, "<u8"),
                       (starts, "<i8"), (place, "<i4"), (times, "<i4")]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
                 *[pa.array([values.astype(kind).tobytes()], pa.binary()) for values, kind in columns]],
                names=["segment", "n_docs", "n_terms", "ids", "no_id", "lengths", "terms", "starts", "places", "times"])
            segment += 1
            ids, absent, lengths, hashes, places, docs, terms = [], [], [], [], [], 0, 0
            return batch

        for batch in batches:
            doc_id = batch.column("doc_id")
            number = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            missing = np.asarray(doc_id.is_null())
            for first, end, found, rows in text_terms(batch.column("text")):
                n = np.diff(rows)
                ids.append(number[first:end])
                absent.append(missing[first:end])
                lengths.append(n)
                hashes.append(found)
                places.append(np.repeat(np.arange(docs, docs + len(n)), n))
                docs, terms = docs + len(n), terms + len(found)
                if terms >= segment_terms or docs >= SEGMENT_DOCS:
                    yield flush()
        if docs:
            yield flush()
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """The written index of every row: one row per segment."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(map_arrow(rows, _segments(segment_terms), _INDEX), "search-index")


def _item_blocks(block_terms: int):
    """One row per block: item ids, and their (term, repeats) lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, held, size
            batch = pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([[h[0] for h in held]], pa.list_(pa.string())),
                 *[pa.array([[h[k].astype("<i8").tobytes() for h in held]], pa.list_(pa.binary())) for k in (1, 2)]],
                names=["block", "ids", "terms", "repeats"])
            block, held, size = block + 1, [], 0
            return batch

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, end, found, rows in text_terms(batch.column("text")):
                for i in range(first, end):
                    terms, repeats = np.unique(found[rows[i - first]: rows[i - first + 1]], return_counts=True)
                    if not len(terms):
                        continue
                    if held and size + len(terms) > block_terms:
                        yield flush()
                    held.append((ids[i], terms.view(np.int64), repeats))
                    size += len(terms)
        if held:
            yield flush()
    return run


class _Segment:
    """Arrays of one index row."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.no_id, self.lengths = read("ids", "<i8"), read("no_id", "u1"), read("lengths", "<i8")
        self.terms, self.starts = read("terms", "<u8"), read("starts", "<i8")
        self.places, self.times = read("places", "<i4"), read("times", "<i4")

    def impacts(self, n_docs: int, n_terms: int) -> np.ndarray:
        """Per posting, what a weight of 1 adds to the score."""
        m = 75 + 25 * self.lengths * n_docs // n_terms
        tf = self.times.astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 12 * m[self.places])


def _frequencies(wanted):
    """(term number, documents holding it) of the block's terms, per segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<i8")
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    total += np.where(own[at] == terms, np.diff(starts)[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])
    return run


class _Best:
    """The k best documents of an item so far; ``least`` is what a document must reach to enter."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.scores = self.ids = np.zeros(0, np.int64)
        self.no_id = np.zeros(0, np.uint8)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        no_id = np.append(self.no_id, no_id)
        order = np.lexsort((ids, no_id, -scores))[: self.k]
        self.scores, self.ids, self.no_id = scores[order], ids[order], no_id[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def accumulate(lists: list[tuple], docs: int) -> tuple[list[tuple], int]:
    """Shortest lists summed into one: (iterators, how many lists were summed).

    A list is (places, scores, bound) with ascending places.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    room, short = docs // SHORT_SHARE, 0
    while short < len(lists) and len(lists[short][0]) <= room:
        room -= len(lists[short][0])
        short += 1
    if short < 2:
        return lists, 0
    sums = np.zeros(docs, np.int64)
    for places, scores, _ in lists[:short]:
        sums[places] += scores
    at = np.flatnonzero(sums)
    return ([(at, sums[at], int(sums[at].max()))] if len(at) else []) + lists[short:], short


def walk(iterators: list[tuple], docs: int, best: _Best, ids: np.ndarray, no_id: np.ndarray, window: int) -> None:
    """Documents of a segment into ``best``: windows of places, leading lists first, the others probed."""
    iterators = sorted(iterators, key=lambda x: x[2])
    bounds = np.cumsum([x[2] for x in iterators])
    for low in range(0, docs, window):
        # The first `probed` lists together cannot lift a document to the threshold.
        probed = int(np.searchsorted(bounds, best.least, "left"))
        if probed == len(iterators):
            return
        high = min(low + window, docs)
        sums = np.zeros(high - low, np.int64)
        for places, scores, _ in iterators[probed:]:
            a, b = np.searchsorted(places, (low, high))
            sums[places[a:b] - low] += scores[a:b]
        rest = int(bounds[probed - 1]) if probed else 0
        at = np.flatnonzero((sums > 0) & (sums + rest >= best.least))
        total = sums[at]
        for i in range(probed - 1, -1, -1):
            if not len(at):
                break
            places, scores, _ = iterators[i]
            there = np.minimum(np.searchsorted(places, at + low), len(places) - 1)
            total = total + np.where(places[there] == at + low, scores[there], 0)
            rest = int(bounds[i - 1]) if i else 0
            good = total + rest >= best.least
            at, total = at[good], total[good]
        if len(at):
            best.add(total, ids[at + low], no_id[at + low])


def _search(block, n_docs: int, n_terms: int, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, items = block.value
        best = [_Best(k) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                part = _Segment(row)
                if not len(part.terms):
                    continue
                docs, gain = len(part.ids), part.impacts(n_docs, n_terms)
                most = np.maximum.reduceat(gain, part.starts[:-1])
                at = np.minimum(np.searchsorted(part.terms, terms), len(part.terms) - 1)
                here = (part.terms[at] == terms) & (weights > 0)
                for (own, repeats), top in zip(items, best):
                    lists = []
                    for t, times in zip(own[here[own]].tolist(), repeats[here[own]].tolist()):
                        j, factor = at[t], times * int(weights[t])
                        a, b = part.starts[j], part.starts[j + 1]
                        lists.append((part.places[a:b], factor * gain[a:b], factor * int(most[j])))
                    if sum(x[2] for x in lists) >= top.least:
                        walk(accumulate(lists, docs)[0], docs, top, part.ids, part.no_id, window)
        sizes = [len(b.scores) for b in best]
        if sum(sizes):
            ids = pa.array(np.concatenate([b.ids for b in best]),
                           mask=np.concatenate([b.no_id for b in best]).astype(bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), ids,
                 pa.array(np.concatenate([b.scores for b in best]))], names=["item", "doc_id", "score"])
    return run


def _leading(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows per item, in two steps so that no task takes the hits of all tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", "part").orderBy(*order)
    hits = (hits.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
            .withColumn("place", F.row_number().over(some)).filter(F.col("place") <= k))
    return (hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id",
           text: str = "text", block_terms: int = BLOCK_TERMS, window: int = WINDOW) -> DataFrame:
    """The ``k`` best documents per item with a score above 0: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(x or 0) for x in totals)
    asked = items.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text")).distinct()
    # Few tasks, whatever the shuffle's partitions: a block costs a pass over the index.
    asked = written(asked, "search-asked")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = asked.repartition(max(1, int(size // (TERM_BYTES * block_terms))))
    blocks = written(map_arrow(asked, _item_blocks(block_terms), "block long, ids array<string>, terms array<binary>, "
                                                    "repeats array<binary>"), "search-items")
    results = []
    for number in (r.block for r in blocks.select("block").orderBy("block").toLocalIterator()):
        if not n_terms:
            break
        row = blocks.filter(F.col("block") == number).first()
        own = [np.frombuffer(x, "<i8").view("<u8") for x in row["terms"]]
        terms = np.unique(np.concatenate(own))
        wanted = spark.sparkContext.broadcast(terms)
        counted = (map_arrow(index.select("terms", "starts"), _frequencies(wanted), "term long, df long")
                   .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
        weights = np.zeros(len(terms), np.int64)
        for t, df in zip(counted.column("term").to_pylist(), counted.column("df").to_pylist()):
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        lists = [(np.searchsorted(terms, x), np.frombuffer(y, "<i8")) for x, y in zip(own, row["repeats"])]
        block = spark.sparkContext.broadcast((terms, weights, lists))
        hits = written(map_arrow(index, _search(block, n_docs, n_terms, k, window), _HITS), "search-hits")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(row["ids"])], "item int, id string")
        results.append(_leading(hits, k).join(names, "item")
                       .select(F.col("id").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``search`` over an index built for it."""
    return search(build_index(docs), items, k)


# Every document that shares a term is scored in full.
SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs),
scaled AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, total),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN scaled USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
