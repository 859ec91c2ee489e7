import random
import re

import numpy as np
import pytest

from tests.llm.cases import awkward_rows, empty, frame, prose
from trendlens.llm import neardup, neardup_sketch
from trendlens.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(rows):
    """(shingles, least reachable id) per row by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5
                    else {tuple(words)} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return [(doc, len(s), least.get(g)) for (doc, _), s, g in zip(rows, sets, group)]


def planted(seed=3):
    """Groups of copies whose similarity lies around the limit, so that no single centre reaches all of them."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(6):
        words = prose(rng, 150).split()
        for k in range(25):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(10 ** 6)
            rows.append((doc, " ".join(copy)))
            doc += 1
    rng.shuffle(rows)
    return rows


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = neardup.link_documents(frame(spark, rows)).collect()
    want = brute_groups([r[:2] for r in rows])
    key = lambda t: [str(x) for x in t]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    # One row of each group: repeated rows and rows without an id are no exception.
    left = [(r.doc_id, r.text) for r in kept.collect()]
    wordless = [r[:2] for r in rows if not (r[1] or "").split()]
    groups = {r.group for r in got if r.group is not None}
    assert len(left) == len(groups) + len(wordless) and len(set(left)) == len(set(left) - set(wordless)) + len(set(wordless))
    assert {i for i, _ in left} == {r.doc_id for r in got if r.kept}
    assert neardup.link_documents(empty(spark)).count() == 0
    assert neardup.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 4])
def test_no_link_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = planted()
    got = neardup.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_groups(rows))


def test_one_row_of_each_group_stays(spark):
    base = prose(random.Random(5), 80).split()
    near = [" ".join(base[:k] + ["edit"] + base[k + 1:]) for k in (3, 40, 70)]
    rows = [(7, near[0]), (7, near[1]), (7, near[1]), (None, near[2]), (9, "alone in its group with some words"), (None, None),
            (None, "no id but words of its own here"), (None, "no id but words of its own here"), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gone_id string, twice_id int")
    kept = neardup.drop_near_duplicates(docs.repartition(4))
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [r for r in left if r[0] == 7] in ([(7, near[0])], [(7, near[1])])
    assert sorted((r for r in left if r[0] != 7), key=str) == sorted([rows[4], rows[5], rows[6], rows[8], rows[9]], key=str)


def test_short_texts_are_linked_too(spark):
    """Texts of 5 to 20 words fill few bins; every link between them is found, with and without the cuts."""
    rng = random.Random(11)
    rows = []
    for g in range(60):
        words = prose(rng, rng.randint(5, 20)).split()
        for k in range(4):
            copy = list(words) + (["more"] if k == 1 else [])
            if k >= 2:
                copy[-1 if k == 2 else 0] = "other%d" % rng.randrange(99)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(brute_groups(rows))
    for exact in (False, True):
        got = neardup.link_documents(docs, exact=exact).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(c != d for d, _, c in want) > 20


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for n in (3, 20, 2000):
        pool = rng.integers(0, 2 ** 63, size=(40, 8 * n // 7 + 1), dtype=np.uint64) * np.uint64(2)
        a = [np.unique(p[:n]) for p in pool]
        b = [np.unique(p[len(p) - n:]) for p in pool]
        real = np.mean([len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in zip(a, b)])
        close = (neardup_sketch.signatures(a) == neardup_sketch.signatures(b)).mean()
        assert abs(real - close) < 0.08


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (205, 200), (200, 205), (7, 7)]
    out = components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.node: r.component for r in out} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200, 205: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, tmp_dir):
    import corpus_pipeline
    from trendlens.llm import dedup_index, pii, quality_rules
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {n: f for n, f in corpus_pipeline.STAGES}
    rows = {r.doc_id: r for r in docs.collect()}
    # The plain version: filter, largest id of equal texts, least id of near groups, masked texts.
    good = {r.doc_id for r in quality_rules.quality_report(docs).collect() if r.kept}
    last = {}
    for i in sorted(good):
        last[rows[i].text] = i
    one = sorted(last.values())
    groups = brute_groups([(i, rows[i].text) for i in one])
    near = sorted(i for i, _, least in groups if i == least)
    stage = docs
    for name, want in (("quality_rules", sorted(good)), ("exact_dedup", one), ("near_dedup", near)):
        stage = kept[name](spark, stage, sf)
        stage.write.parquet(f"{tmp_dir}/{name}")
        stage = spark.read.parquet(f"{tmp_dir}/{name}")
        assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == want
    masked = kept["personal_data"](spark, stage, sf)
    assert masked.columns == docs.columns
    assert {r.doc_id: r.text for r in masked.collect()} == {i: pii.mask(rows[i].text) for i in near}
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(pieces.doc_id.unique()) == near
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert dedup_index.drop_duplicates(docs).count() == len({r.text for r in rows.values()})


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_and_empty_tables(spark, stage):
    import corpus_pipeline
    name, function = corpus_pipeline.STAGES[stage]
    for docs in (frame(spark, awkward_rows()), empty(spark)):
        out = function(spark, docs, "/root/testdata/sf0.001")
        out.collect()
        if stage < 4:
            assert out.columns == docs.columns


def test_registered_queries():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
