import duckdb
import numpy as np
import pytest

from trendlens.llm import embedding_join, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<{}>, label int, row string, node long"


def brute(rows, least=0.95):
    """Sorted (vec_id, links, component) by comparing all pairs."""
    group, links = list(range(len(rows))), [0] * len(rows)

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i, (_, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    a, b = group[i], group[j]
                    group = [b if g == a else g for g in group]
    lowest = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            lowest[g] = min(lowest.get(g, i), i)
    return sorted(((i, n, lowest.get(g)) for (i, _), n, g in zip(rows, links, group)), key=str)


def found(frame):
    rows = frame.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA.format(kind)).repartition(3)


def clustered(seed, n, width):
    """Chains and balls of vectors around the limit, in float32."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12 + 1, width))
    m = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.15, 0.22], (n, 1))
    return [(i, x.tolist()) for i, x in enumerate(m.astype(np.float32).astype(float))]


@pytest.mark.parametrize("sizes", [{}, {"leaf": 4, "interval_bytes": 1500, "fan": 2}])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_pairs(spark, sizes, kind):
    rows = clustered(1, 240, 12)
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:30])] + [(2000, rows[0][1])] * 5
    want = brute(rows)
    assert sum(n for _, n, _ in want) > 500
    assert found(embedding_join.link_vectors(frame(spark, rows, kind), **sizes)) == want


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]),
            (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1e300, 1e300]),
            (13, [1e-300, 1e-300]), (None, [1.0, 1.0]), (None, [-1.0, 0.0]), (None, None), (14, [3.0]), (15, [-3.0]),
            (16, [5.0]), (16, [5.0]), (16, None)]
    assert found(embedding_join.link_vectors(frame(spark, rows))) == brute(rows)


def test_empty_and_unusable_tables(spark):
    none = spark.createDataFrame([], SCHEMA.format("float"))
    assert embedding_join.link_vectors(none).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert embedding_join.link_vectors(none).count() == 0
    assert found(embedding_join.link_vectors(frame(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1), (2, 0, 2)]


def test_coordinates_never_part_vectors_further():
    rng = np.random.default_rng(2)
    axes = np.linalg.qr(rng.normal(size=(20, 20)))[0][:, : embedding_join.HEAD]
    for width in (3, 20, 31):
        m = embedding_join.unit(rng.normal(size=(60, width)))
        h = embedding_join.heads(m, axes)
        apart = lambda x: ((x[:, None] - x[None]) ** 2).sum(-1)
        assert (apart(h) <= apart(m) + 1e-12).all()


def test_order_lets_tasks_skip_distant_runs():
    rng = np.random.default_rng(3)
    m = embedding_join.unit(np.repeat(np.eye(16), 8, 0) + rng.normal(size=(128, 16)) * 0.01)
    axes = np.eye(16)[:, : embedding_join.HEAD]
    h = embedding_join.heads(m, axes)
    order = np.lexsort(np.floor((h + 1) / 0.16).T[::-1])
    part = (np.arange(128)[order], np.ones(128, np.int64), h[order], np.full(128, 16), [x.tobytes() for x in m[order]])
    one = embedding_join._Sequence([part], 8)
    _, products = embedding_join.join_sequences(one, one, 0.95, "f8")
    assert products < 80  # of 136 pairs of runs
    near = (m @ m.T >= 0.95).sum(1) - 1
    assert (one.links == near[order]).all()


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.oracle_sql()["op12_embedding_join"]).fetchall()
    got = queries.queries()["op12_embedding_join"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want)
