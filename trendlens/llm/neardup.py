"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. *Sketch.* Each text's set of word shingles gives a 128-bit fingerprint and
   BINS minimum hashes. Texts with the same set are one class from here on, so
   copies never meet in pairs.
2. *Stars.* Classes that agree in all values of a band share a bucket. Every
   member is paired with the bucket's least member only; pairs whose sketches
   are far apart are left out (their similarity would have to be more than six
   standard deviations off), the others are confirmed on the full sets.
3. *Rest.* A star can miss a link between two members that are no neighbours
   of its centre. Where a bucket's members are still in several components,
   members outside its main component are compared, by a finer sketch, with
   the members of other components (in blocks of bounded size), and what
   passes is confirmed on the full sets too. Each such pair is met once, in
   the first band that it shares.
4. *Components* of the confirmed links give the groups.

Full sets are made a second time, for bucket members only: a bitmap of fixed
size (FILTER_BITS) picks their texts in the scan, so texts are never shuffled;
where it is too small for a corpus it only lets more sets through.

Two texts of similarity 0.75 share no band with a chance of 5e-6. A class or
bucket of any size is split by Spark's skew join (sides are plain shuffles) or
by blocks; class sizes are partial aggregates.

Null texts and texts without words are linked with nothing. Null ids are
ignored by the minimum (a group of null ids has a null component). Rows that
are equal in id and text are one document; ``drop_near_duplicates`` keeps one row
of each group whatever its ids. An empty table gives no row; other columns are
not read here and kept there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix64, written
from .components import components
from .neardup_sketch import BINS, band_keys, fingerprint, shingle_sets, signatures

FILTER_BITS = 1 << 24   # 2 MB, broadcast
STAR_LEAST = 0.5        # agreement of BINS values below which a star pair is left out
FINE_BINS = 1024        # finer sketch of the rest: one byte per bin
FINE_LEAST = 0.685      # 4.8 standard deviations below 0.75
BLOCK = 1024            # members per block of a bucket that stars did not join

_U = np.uint64


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        sets: list[np.ndarray] = []
        sizes, prints, signed = [], [], []

        def flush() -> None:
            values = signatures(sets).astype("<u2")
            signed.extend(v.tobytes() for v in values)
            sets.clear()

        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            prints.append(fingerprint(s))
            sets.append(s)
            if len(sets) >= 512:
                flush()
        flush()
        one, two = zip(*prints) if prints else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + len(sizes))), batch.column("doc_id"), batch.column("text_hash"),
             pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
             pa.array(signed, pa.binary())],
            names=["row", "doc_id", "text_hash", "n", "f1", "f2", "sig"])
        row += len(sizes)


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BINS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_values(batch.column("sig")))
        nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], names=["key", "node"])


def _similar_enough(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = (_values(batch.column("sig_a")) == _values(batch.column("sig_b"))).mean(1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(close))
    return run


def _confirm(least: int):
    """Pairs whose full sets have ``100 * both >= least * either``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                good.append(100 * both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def _bits(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.view(_U)) % _U(FILTER_BITS)).astype(np.int64)


def bit_filter(keys: DataFrame) -> bytes:
    """Bitmap of FILTER_BITS of a column of longs, gathered as at most FILTER_BITS / 32 partial words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bits(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(1 << (bit & 31))], names=["word", "bits"])

    words = map_arrow(keys, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, "<u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def _full_sets(wanted):
    """Sets of the texts whose hash is in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(wanted.value, "<u4")
        for batch in batches:
            bit = _bits(batch.column("text_hash").to_numpy())
            batch = batch.filter(pa.array((bitmap[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)))
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"),
                                                  pa.array(sets, pa.binary())], names=["doc_id", "text_hash", "set"])
    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte per bin of a sketch of FINE_BINS."""
    for batch in batches:
        sets = [np.frombuffer(raw.as_buffer(), "<u8") for raw in batch.column("set")]
        out = []
        for a in range(0, len(sets), 256):
            out += [v.tobytes() for v in signatures(sets[a: a + 256], FINE_BINS).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("sig"), pa.array(out, pa.binary())],
                                         names=["node", "sig", "fine"])


def _rest_pairs(least: float):
    """Blocks sorted by (key, pblock, tblock, probes first): close pairs of different components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, probes = None, None

        def arrays(rows: list[dict]) -> tuple:
            return (np.array([r["node"] for r in rows]), np.array([r["component"] for r in rows]),
                    np.array([r["probe"] for r in rows], bool), _values_of([r["sig"] for r in rows]),
                    np.frombuffer(b"".join(r["fine"] for r in rows), np.uint8).reshape(-1, FINE_BINS))

        held: list[dict] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                name = (r["key"], r["pblock"], r["tblock"])
                if name != block:
                    found += _compare(block, probes, held, arrays, least)
                    block, probes, held = name, [], []
                (probes if r["role"] == 0 else held).append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                              pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = _compare(block, probes, held, arrays, least) if block else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                          pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
    return run


def _values_of(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<u2").reshape(-1, BINS)


def _compare(block, probes, targets, arrays, least: float) -> list[tuple[int, int]]:
    if not block or not probes or not targets:
        return []
    nodes, comps, is_probe, sigs, fine = arrays(targets)
    keys = band_keys(sigs)
    band = int(np.flatnonzero(keys[0] == block[0])[0])
    found = []
    for node, comp, _, sig, sketch in zip(*arrays(probes)):
        other = (comps != comp) & (~is_probe | (nodes > node))  # two probes: once
        if band:  # met in an earlier band
            own = band_keys(sig[None])[0, :band]
            other &= ~(keys[:, :band] == own).any(1)
        at = np.flatnonzero(other)
        if len(at):
            close = (fine[at] == sketch).mean(1) >= least
            found += [(int(node), int(x)) for x in nodes[at[close]]]
    return found


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 75,
                   exact: bool = False) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept, n_links and group of its class.

    ``exact`` confirms every pair that shares a band on full sets, without the cuts by sketches.
    """
    star_least, fine_least = (0.0, 0.0) if exact else (STAR_LEAST, FINE_LEAST)
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text"),
                        F.xxhash64(body).alias("text_hash"))
    sketches = written(map_arrow(
        plain, _sketches, "row long, doc_id long, text_hash long, n long, f1 long, f2 long, sig binary"),
        "neardup-sketches")
    some = sketches.filter("n > 0")
    classes = written(
        some.groupBy("f1", "f2").agg(F.min("doc_id").alias("lowest"),
                                     F.min(F.struct("row", "doc_id", "text_hash", "sig")).alias("first"))
        .select("f1", "f2", "lowest", F.col("first.row").alias("node"), "first.doc_id", "first.text_hash", "first.sig"),
        "neardup-classes")

    banded = map_arrow(classes.select("node", "sig"), _bands, "key long, node long")
    centres = (banded.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("size"))
               .filter("size > 1"))
    members = written(banded.join(written(centres, "neardup-centres"), "key"), "neardup-members")

    wanted = written(members.select("node").distinct().join(classes, "node")
                     .select("node", "doc_id", "text_hash", "sig"), "neardup-wanted")
    bitmap = spark.sparkContext.broadcast(bit_filter(wanted.select("text_hash")))
    full = (map_arrow(plain, _full_sets(bitmap), "doc_id long, text_hash long, set binary")
            .dropDuplicates(["doc_id", "text_hash"]))
    same = full["doc_id"].eqNullSafe(wanted["doc_id"]) & (full["text_hash"] == wanted["text_hash"])
    sets = written(full.join(wanted, same).select(wanted["node"], wanted["sig"], "set"), "neardup-sets")

    signed = wanted.select("node", "sig")
    stars = (members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
             .join(signed.toDF("a", "sig_a"), "a").join(signed.toDF("b", "sig_b"), "b"))
    close = map_arrow(stars, _similar_enough(star_least), "a long, b long")
    links = written(map_arrow(_with_sets(close, sets), _confirm(least), "a long, b long"), "neardup-links")

    rest = written(_rest(members, components(links.toDF("u", "v")), sets, fine_least), "neardup-rest")
    more = written(map_arrow(_with_sets(rest, sets), _confirm(least), "a long, b long"), "neardup-links")
    all_links = links.union(more)
    groups = written(components(all_links.toDF("u", "v")), "neardup-components")

    degree = (all_links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
              .agg(F.count("*").alias("n_links")))
    lowest = (groups.join(classes.select("node", "lowest"), "node")
              .groupBy("component").agg(F.min("lowest").alias("component_id")))
    named = groups.join(written(lowest, "neardup-lowest"), "component").select("node", "component_id", "component")
    resolved = written(
        classes.select("f1", "f2", "node", "lowest").join(named, "node", "left").join(degree, "node", "left")
        .select("f1", "f2", F.coalesce("component_id", "lowest").alias("component_id"),
                F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("group")),
        "neardup-resolved")
    found = some.select("doc_id", "text_hash", "n", "f1", "f2").join(resolved, ["f1", "f2"])
    alone = sketches.filter("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"),
                                            F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group"))
    return (found.select("doc_id", "text_hash", "n", "component_id", "n_links", "group").unionByName(alone)
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links", "group"))


def _rest(members: DataFrame, joined: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Close pairs in buckets whose members are in several components."""
    labelled = written(
        members.select("key", "node").join(joined, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component")), "neardup-labelled")
    mixed = (labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
             .groupBy("key").agg(F.count("*").alias("components"), F.sum("n").alias("n"),
                                 F.max(F.struct("n", "component")).alias("main"))
             .filter("components > 1")
             .select("key", F.col("main.component").alias("main"),
                     F.ceil(F.col("n") / BLOCK).alias("tblocks"),
                     F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("pblocks")))
    rows = written(labelled.join(written(mixed, "neardup-mixed"), "key")
                   .withColumn("probe", F.col("component") != F.col("main")), "neardup-mixed-members")
    fine = map_arrow(rows.select("node").distinct().join(sets, "node"), _fine, "node long, sig binary, fine binary")
    rows = rows.join(written(fine, "neardup-fine"), "node")
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks))
    spread = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    columns = ["key", "pblock", "tblock", "role", "node", "component", "probe", "sig", "fine"]
    probes = (rows.filter("probe").withColumn("pblock", place("pblocks")).withColumn("tblock", spread("tblocks"))
              .withColumn("role", F.lit(0)).select(*columns))
    targets = (rows.withColumn("tblock", place("tblocks")).withColumn("pblock", spread("pblocks"))
               .withColumn("role", F.lit(1)).select(*columns))
    blocks = (probes.unionByName(targets).repartition("key", "pblock", "tblock")
              .sortWithinPartitions("key", "pblock", "tblock", "role", "node"))
    return map_arrow(blocks, _rest_pairs(least), "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, all columns as they are; rows without words all stay.

    The one with the least id stays (null ids last), among equal ids that with the least text hash, among rows equal in
    both any one.
    """
    linked = written(link_documents(docs, id_col, text).select("doc_id", "text_hash", "group"), "neardup-linked")
    grouped = linked.filter("group IS NOT NULL")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("stays")
    first = written(grouped.groupBy("group").agg(stays), "neardup-first")
    first = first.select("group", F.col("stays.doc_id").alias("first_id"), F.col("stays.text_hash").alias("first_hash"))
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = grouped.join(first, "group").filter(~own).select(F.col("doc_id").alias("gone_id"),
                                                            F.col("text_hash").alias("gone_hash"))
    gone = written(gone.distinct(), "neardup-gone")
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    key, code = docs[id_col].cast("long"), F.xxhash64(body)
    kept = docs.join(gone, key.eqNullSafe(gone["gone_id"]) & (code == gone["gone_hash"]), "left_anti")
    twice = written(grouped.groupBy("doc_id", "text_hash").count().filter("count > 1")
                    .select(F.col("doc_id").alias("twice_id"), F.col("text_hash").alias("twice_hash")), "neardup-twice")
    if twice.isEmpty():
        return kept
    # Rows equal in id and text: only they are shuffled by it.
    same = key.eqNullSafe(twice["twice_id"]) & (code == twice["twice_hash"])
    once = (kept.join(twice, same, "left_semi").withColumn("_neardup_key", F.struct(key, code))
            .dropDuplicates(["_neardup_key"]).drop("_neardup_key"))
    return kept.join(twice, same, "left_anti").unionByName(once)


# All pairs that share a shingle; for tables where that is affordable.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5
                               THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
          FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(lowest.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(lowest.b, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest ON lowest.a = d.doc_id
"""
