import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from tests.llm.cases import awkward_rows, empty, frame
from trendlens.llm import queries, ranked_search

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, k):
    """{item: [(doc_id, score)]} by scoring every document in full."""
    counted = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = {}
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                        (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out[item] = [(None if no else d, -s) for s, no, d in sorted(scored)[:k]]
    return {i: x for i, x in out.items() if x}


def found(frame):
    out = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: r.rank):
        assert r.rank == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, rank int, doc_id string")


ITEMS = [(1, "the of and THE the", 0, ""), (2, None, 0, ""), (3, "", 0, ""), (4, "zzzz qqqq", 0, ""),
         (5, "a b c d e one 日本 ü", 0, ""), (6, "ladie derdie thela line same", 0, ""), (6, "ladie derdie thela line same", 0, "")]


@pytest.mark.parametrize("sizes", [(2_000_000, 200_000, 4096), (50, 3, 2)])
def test_awkward_tables(spark, sizes):
    rows = awkward_rows()
    words = " ".join(rows[8][1].split()[:12])
    items = [*ITEMS, (7, words, 0, ""), (None, "one", 0, "")]
    index = ranked_search.build_index(frame(spark, rows), segment_terms=sizes[0])
    got = found(ranked_search.search(index, items_frame(spark, items), 6, block_terms=sizes[1], window=sizes[2]))
    assert got == brute([r[:2] for r in rows], {(i, t) for i, t, *_ in items}, 6)


def test_empty_tables(spark):
    docs, items = frame(spark, awkward_rows()), items_frame(spark, ITEMS)
    for a, b in ((empty(spark), items), (docs, items.limit(0)), (docs, items.filter("item_id in (2, 3)"))):
        out = ranked_search.rank_documents(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_one_index_serves_several_item_sets(spark):
    rows = [(i, " ".join(random.Random(i).choices("ab bc cd de ef fg gh".split(), k=30))) for i in range(40)]
    index = ranked_search.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    for text in ("ab cd", "gh gh ef x"):
        got = found(ranked_search.search(index, spark.createDataFrame([("q", text)], "item_id string, text string"), 5))
        assert got == brute(rows, [("q", text)], 5)


def test_walk_equals_full_sums():
    rng = np.random.default_rng(5)
    for _ in range(200):
        docs = int(rng.integers(1, 60))
        lists, full = [], np.zeros(docs, np.int64)
        for _ in range(int(rng.integers(1, 8))):
            places = np.flatnonzero(rng.random(docs) < rng.choice([0.05, 0.3, 0.9]))
            if len(places):
                scores = rng.integers(1, 50, len(places)) * int(rng.choice([1, 20]))
                full[places] += scores
                lists.append((places, scores, int(scores.max())))
        best = ranked_search._Best(4)
        iterators, summed = ranked_search.accumulate(lists, docs)
        assert summed != 1 and len(iterators) <= len(lists)
        ranked_search.walk(iterators, docs, best, np.arange(docs), np.zeros(docs, np.uint8), 7)
        want = sorted((-s, i) for i, s in enumerate(full.tolist()) if s > 0)[:4]
        assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want


def test_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()["op11_ranked_search"]).fetchall()
    got = queries.queries()["op11_ranked_search"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
