"""Embedding near duplicates by an epsilon grid order join.

1. *Classes.* Equal vectors are one node with a number of copies, counted by
   partial aggregates, so copies are never compared.
2. *Leading dimensions.* Second moments of all nodes, summed by Spark, give the
   principal dimensions; a node's coordinates are those of its unit vector in
   the first HEAD of them, and the length of what is left. Unit vectors whose
   cosine is at least c lie within ``sqrt(2 - 2c)``, and so do their coordinates.
3. *Order.* Nodes are sorted by vector length, then by the grid cells of their
   coordinates, and cut into intervals of at most INTERVAL_BYTES.
4. *Join.* Pairs of runs of intervals are split FAN by FAN, level by level, in
   joins of their bounding boxes; pairs of boxes farther apart than epsilon go.
   Each pair of intervals left is one group of rows in a shuffle; its task goes
   on halving both sequences in the same way down to LEAF vectors, which are
   compared by a matrix product in double precision.
5. *Links* are never sent as pairs: a task sums each node's links, weighted by
   copies, and joins linked nodes in a forest. What leaves it is one row per
   linked node; the forests of all tasks give the components.

A node in many intervals' reach is shuffled once per interval pair. Vectors of
the same kind of length are compared only; a vector that is null, zero, or holds
null, NaN or infinite components links with nothing (0 links, a component of its
own). Rows are vectors: repeated rows link with each other. A null id takes no
part in the minimum; a component of null ids only has a null id, and ``kept`` is
true where id and component id are equal or both null. An empty table gives no
row. Other columns, labels among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix64, written
from .components import components

HEAD = 8                    # leading principal dimensions of the grid
WIDEST = 512                # principal dimensions are sought among the first WIDEST components
CELLS = 2                   # grid cells per epsilon
INTERVAL_BYTES = 16 << 20   # stored vectors of one interval of the order
LEAST_INTERVALS = 6         # tables of at least SMALL nodes are cut into so many
SMALL = 4096
FAN = 8                     # intervals joined to one at each level above
LEAF = 256                  # vectors compared by one matrix product (squared)

_U = np.uint64
_HEADS = [f"h{i}" for i in range(HEAD + 1)]
_ROWS = "row long, vec_id long, f1 long, f2 long, width int, raw binary"


def _matrices(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) per length of the usable vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    cut = column.offsets.to_numpy()
    width = np.diff(cut)
    width[np.asarray(column.is_null())] = 0
    values = column.values
    data = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        m = data[cut[rows][:, None] + np.arange(w)] + np.dtype(kind).type(0)  # -0.0 becomes 0.0
        good = np.isfinite(m).all(1) & (m != 0).any(1)
        if good.any():
            yield rows[good], m[good]


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, also where squares would overflow."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _prints(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each row's vector."""
    bits = m.astype(np.float64).view(_U)
    place = mix64(np.arange(1, bits.shape[1] + 1, dtype=_U) * _U(0xD1342543DE82EF95))
    once = mix64(bits ^ place)
    return (once.sum(1, dtype=_U).view(np.int64),
            mix64(once + place).sum(1, dtype=_U).view(np.int64))


def _read(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n = batch.num_rows
            one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
            width, raw = np.zeros(n, np.int32), [None] * n
            for rows, m in _matrices(batch.column("v"), kind):
                one[rows], two[rows] = _prints(m)
                width[rows] = m.shape[1]
                for i, x in zip(rows.tolist(), m):
                    raw[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("vec_id"), pa.array(one), pa.array(two),
                 pa.array(width), pa.array(raw, pa.binary())], names=[c.split()[0] for c in _ROWS.split(", ")])
            row += n
    return run


def _stacked(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, stored matrix) per length."""
    width = batch.column("width").to_numpy()
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        held = batch.column("raw").take(pa.array(rows))
        yield rows, np.frombuffer(b"".join(x.as_py() for x in held), kind).reshape(len(rows), w)


def _moments(width: int, kind: str):
    """Sums of products of the unit vectors of one length: rows (i, j, s); j = -1 for plain sums."""
    side = min(width, WIDEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((side, side)), np.zeros(side)
        for batch in batches:
            for _, m in _stacked(batch, kind):
                m = unit(m)[:, :side]
                products += m.T @ m
                sums += m.sum(0)
        i, j = np.triu_indices(side)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, np.arange(side)).astype(np.int32)),
             pa.array(np.append(j, np.full(side, -1)).astype(np.int32)), pa.array(np.append(products[i, j], sums))],
            names=["i", "j", "s"])
    return run


def principal(nodes: DataFrame, kind: str) -> np.ndarray:
    """(components, HEAD) leading principal dimensions of the nodes of the commonest length."""
    common = nodes.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    side = min(common["width"], WIDEST)
    own = nodes.filter(F.col("width") == common["width"])
    sums = (map_arrow(own.select("width", "raw"), _moments(common["width"], kind), "i int, j int, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow())  # side * (side + 3) / 2 rows
    i, j, s = (sums.column(c).to_numpy() for c in "ijs")
    mean, product = np.zeros(side), np.zeros((side, side))
    mean[i[j < 0]] = s[j < 0] / common["count"]
    product[i[j >= 0], j[j >= 0]] = product[j[j >= 0], i[j >= 0]] = s[j >= 0] / common["count"]
    _, vectors = np.linalg.eigh(product - np.outer(mean, mean))
    return np.ascontiguousarray(vectors[:, ::-1][:, :HEAD])


def heads(m: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """HEAD + 1 coordinates of unit vectors: no two of them come to lie farther apart than the vectors.

    Vectors of another length than ``axes`` use as many components as both have.
    """
    both = min(m.shape[1], len(axes))
    out = np.zeros((len(m), HEAD + 1))
    out[:, : axes.shape[1]] = m[:, :both] @ axes[:both]
    out[:, HEAD] = np.sqrt(np.maximum((m * m).sum(1) - (out[:, :HEAD] ** 2).sum(1), 0)) if both == m.shape[1] else 0
    return out


def _placed(axes: np.ndarray, epsilon: float, kind: str):
    """Coordinates and the sort key: length, cells, then finer coordinates and the node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((n, HEAD + 1))
            for rows, m in _stacked(batch, kind):
                out[rows] = heads(unit(m), axes)
            cell = np.floor((out + 1) / (epsilon / CELLS)).astype(">i4")
            fine = ((out + 1) * 30000).astype(">i4")
            key = np.concatenate([
                batch.column("width").to_numpy().astype(">i4")[:, None].view(np.uint8).reshape(n, -1),
                cell.view(np.uint8).reshape(n, -1), fine.view(np.uint8).reshape(n, -1),
                batch.column("node").to_numpy().astype(">i8")[:, None].view(np.uint8).reshape(n, -1)], 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([k.tobytes() for k in key], pa.binary()), *map(pa.array, out.T)],
                names=[*batch.schema.names, "key", *_HEADS])
    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))],
            names=[*batch.schema.names, "part", "seen"])
        seen += n


def in_grid_order(nodes: DataFrame, epsilon: float, kind: str, interval: int, parts: int) -> DataFrame:
    """Nodes with their interval number and their place in the whole order."""
    axes = principal(nodes, kind)
    schema = ("node long, copies long, width int, raw binary, key binary, "
              + ", ".join(f"{h} double" for h in _HEADS))
    keyed = map_arrow(nodes.select("node", "copies", "width", "raw"), _placed(axes, epsilon, kind), schema)
    keyed = written(keyed, "embedding-keyed").repartitionByRange(parts, "key").sortWithinPartitions("key").drop("key")
    schema = schema.replace("key binary, ", "") + ", part int, seen long"
    ordered = written(map_arrow(keyed, _numbered, schema), "embedding-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = (ordered.groupBy("part").agg(F.count("*").alias("n"))
              .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return (ordered.join(starts, "part").withColumn("place", F.col("start") + F.col("seen"))
            .withColumn("interval", F.floor(F.col("place") / interval)).drop("part", "seen", "start"))


def near_intervals(ordered: DataFrame, epsilon: float, intervals: int, fan: int) -> DataFrame:
    """Pairs (a <= b) of intervals whose boxes come within epsilon, found by splitting runs of intervals."""
    boxes = written(ordered.groupBy("interval").agg(
        F.min("width").alias("w0"), F.max("width").alias("w1"),
        *[f(h).alias(f"{h}_{k}") for h in _HEADS for k, f in (("low", F.min), ("high", F.max))]), "embedding-boxes")
    levels = [boxes]
    while fan ** (len(levels) - 1) < intervals:
        levels.append(levels[-1].withColumn("interval", F.floor(F.col("interval") / fan)).groupBy("interval").agg(
            F.min("w0").alias("w0"), F.max("w1").alias("w1"),
            *[f(f"{h}_{k}").alias(f"{h}_{k}") for h in _HEADS for k, f in (("low", F.min), ("high", F.max))]))
    limit = epsilon * epsilon + 1e-9

    def named(level: DataFrame, side: str) -> DataFrame:
        columns = [F.col(c).alias(f"{side}_{c}") for c in level.columns]
        return level.select(F.floor(F.col("interval") / fan).alias(f"{side}_up"), *columns)

    def gap(h: str):
        away = F.greatest(F.col(f"a_{h}_low") - F.col(f"b_{h}_high"), F.col(f"b_{h}_low") - F.col(f"a_{h}_high"), F.lit(0.0))
        return away * away

    pairs = ordered.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in levels[-2::-1]:
        distance = gap(_HEADS[0])
        for h in _HEADS[1:]:
            distance = distance + gap(h)
        pairs = written(
            pairs.join(named(level, "a"), F.col("a") == F.col("a_up"))
            .join(named(level, "b"), F.col("b") == F.col("b_up"))
            .filter("a_interval <= b_interval AND a_w0 <= b_w1 AND b_w0 <= a_w1").filter(distance <= limit)
            .select(F.col("a_interval").alias("a"), F.col("b_interval").alias("b")), "embedding-pairs")
    return pairs


class _Sequence:
    """One interval in a task: unit vectors in order, with boxes of its runs of ``leaf``."""

    def __init__(self, parts: list[tuple], leaf: int) -> None:
        self.leaf = leaf
        self.nodes = np.concatenate([p[0] for p in parts])
        self.copies = np.concatenate([p[1] for p in parts])
        self.heads = np.concatenate([p[2] for p in parts])
        self.width = np.concatenate([p[3] for p in parts])
        self.raw = [r for p in parts for r in p[4]]
        self.links = np.zeros(len(self.nodes), np.int64)
        edges = np.arange(0, len(self.nodes), leaf)
        both = np.concatenate([self.heads, self.width[:, None]], 1)
        self.low, self.high = np.minimum.reduceat(both, edges), np.maximum.reduceat(both, edges)
        self._units: dict[int, list] = {}

    def units(self, run: int, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, unit vectors) of a run per length."""
        if run not in self._units:
            places = np.arange(run * self.leaf, min((run + 1) * self.leaf, len(self.nodes)))
            out = []
            for w in np.unique(self.width[places]):
                own = places[self.width[places] == w]
                m = np.frombuffer(b"".join(self.raw[i] for i in own), kind).reshape(len(own), w)
                out.append((own, unit(m)))
            if len(self._units) >= 64:  # bounds the doubles kept of one interval
                self._units.pop(next(iter(self._units)))
            self._units[run] = out
        return self._units[run]


class _Forest:
    """Joined places of two sequences."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.root, high, low)
            while True:  # every place points at its root again
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def join_sequences(a: _Sequence, b: _Sequence, least: float, kind: str) -> tuple[_Forest, int]:
    """Links within ``a`` (if it is ``b``) or between both: sums in ``links``, joined places, products made."""
    same = a is b
    limit = 2 - 2 * least + 1e-9
    forest, products = _Forest(len(a.nodes) + (0 if same else len(b.nodes))), 0
    shift = 0 if same else len(a.nodes)

    def compare(i: int, j: int) -> None:
        for x, u in a.units(i, kind):
            for y, v in b.units(j, kind):
                if u.shape[1] != v.shape[1]:
                    continue
                near = u @ v.T >= least
                if same and i == j:
                    near &= x[:, None] != y[None]
                p, q = np.nonzero(near)
                if len(p):
                    a.links[x] += near @ b.copies[y]
                    if not (same and i == j):
                        b.links[y] += a.copies[x] @ near
                    forest.join(x[p], y[q] + shift)

    todo = [(0, len(a.low), 0, len(b.low))]
    while todo:
        i, k, j, m = todo.pop()
        if same and m <= i:
            continue  # the mirror image of another pair
        al, ah = a.low[i:k].min(0), a.high[i:k].max(0)
        bl, bh = b.low[j:m].min(0), b.high[j:m].max(0)
        away = np.maximum(np.maximum(al - bh, bl - ah), 0)
        if away[-1] or (away[:-1] ** 2).sum() > limit:
            continue
        if k - i == 1 and m - j == 1:
            if not same or i <= j:
                compare(i, j)
                products += 1
        elif k - i >= m - j:
            half = (i + k) // 2
            todo += [(half, k, j, m), (i, half, j, m)]
        else:
            half = (j + m) // 2
            todo += [(i, k, half, m), (i, k, j, half)]
    return forest, products


def _join(least: float, kind: str, leaf: int):
    def result(sides: list[list[tuple]]) -> pa.RecordBatch:
        a = _Sequence(sides[0], leaf)
        b = _Sequence(sides[1], leaf) if sides[1] else a
        forest, _ = join_sequences(a, b, least, kind)
        nodes = a.nodes if a is b else np.concatenate([a.nodes, b.nodes])
        links = a.links if a is b else np.concatenate([a.links, b.links])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[forest.root[some]])],
            names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sides = None, [[], []]
        for batch in batches:
            name = np.stack([batch.column(c).to_numpy() for c in ("a", "b", "role")], 1)
            cuts = np.append(np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(1))), len(name))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if tuple(name[x][:2]) != pair:
                    if pair is not None:
                        yield result(sides)
                    pair, sides = tuple(name[x][:2]), [[], []]
                part = batch.slice(x, y - x)
                sides[int(name[x][2])].append((
                    part.column("node").to_numpy(), part.column("copies").to_numpy(),
                    np.stack([part.column(h).to_numpy() for h in _HEADS], 1), part.column("width").to_numpy(),
                    part.column("raw").to_pylist()))
        if pair is not None:
            yield result(sides)
    return run


def link_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", column: str = "embedding",
                 interval_bytes: int = INTERVAL_BYTES, fan: int = FAN, leaf: int = LEAF) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = "f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "f8"
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.col(column).cast("array<float>" if kind == "f4" else "array<double>").alias("v"))
    rows = written(map_arrow(plain, _read(f"<{kind}"), _ROWS), "embedding-rows")
    nodes = written(rows.filter("width > 0").groupBy("f1", "f2", "width").agg(
        F.min("vec_id").alias("lowest"), F.count("*").alias("copies"), F.min("row").alias("node"),
        F.first("raw").alias("raw")), "embedding-nodes")

    size = nodes.agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("bytes")).first()
    if size["n"]:
        epsilon = float(np.sqrt(2 - 2 * least))
        each = max(leaf, int(interval_bytes // max(1, size["bytes"] // size["n"])))
        if size["n"] >= SMALL:
            each = min(each, -(-size["n"] // LEAST_INTERVALS))
        intervals = -(-size["n"] // each)
        ordered = written(in_grid_order(nodes, epsilon, f"<{kind}", each, intervals), "embedding-placed")
        pairs = near_intervals(ordered, epsilon, intervals, fan)
        sides = (pairs.select(F.col("a").alias("interval"), "a", "b", F.lit(0).alias("role"))
                 .union(pairs.filter("a <> b").select("b", "a", "b", F.lit(1))))
        # As many tasks as pairs, within bounds: a pair is seconds of work, and AQE judges by bytes.
        tasks = int(min(max(2 * pairs.count(), 8), 20_000))
        grouped = (ordered.join(sides, "interval").drop("interval").repartition(tasks, "a", "b")
                   .sortWithinPartitions("a", "b", "role", "place"))
        found = written(map_arrow(grouped, _join(least, f"<{kind}", leaf), "node long, links long, root long"),
                        "embedding-links")
        groups = written(components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))),
                         "embedding-components")
        lowest = (groups.join(nodes.select("node", "lowest"), "node").groupBy("component")
                  .agg(F.min("lowest").alias("component_id")))
        named = groups.join(written(lowest, "embedding-lowest"), "component").select("node", "component_id")
        linked = found.groupBy("node").agg(F.sum("links").alias("links"))
        resolved = written(
            nodes.select("f1", "f2", "width", "node", "lowest", "copies").join(named, "node", "left")
            .join(linked, "node", "left")
            .select("f1", "f2", "width", F.coalesce("component_id", "lowest").alias("component_id"),
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "embedding-resolved")
    else:
        resolved = nodes.select("f1", "f2", "width", F.col("lowest").alias("component_id"),
                                F.lit(0).cast("long").alias("n_links"))
    found = (rows.filter("width > 0").select("vec_id", "f1", "f2", "width").join(resolved, ["f1", "f2", "width"])
             .select("vec_id", "n_links", "component_id"))
    alone = rows.filter("width = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


# All pairs; for tables where that is affordable.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(degree.n, 0) AS n_links,
       least(e.vec_id, coalesce(lowest.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(lowest.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN lowest ON lowest.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id
"""
