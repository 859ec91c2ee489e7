import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import awkward_rows, empty, frame
from trendlens.llm import queries, spelling

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(docs):
    words = brute_words(docs)
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return out


def typos(seed, letters="abcdé", n=120):
    """Texts over few letters, so that many words are near, with frequencies that chain."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(n)]
    words = []
    for w in base:
        for k in range(rng.choice([1, 3, 4, 9, 30])):
            i = rng.randrange(len(w))
            words += [w, rng.choice([w, w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + "a" + w[i + 1:]])]
    rng.shuffle(words)
    return [(d, " ".join(words[d::25])) for d in range(25)]


@pytest.mark.parametrize("sizes", [{}, {"block_words": 7, "batch": 5, "held": 3}])
def test_against_all_pairs(spark, sizes):
    rows = [(d, t, "en", "s", 1, "k", None, 0) for d, t in typos(1)]
    got = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n]
           for r in spelling.group_variants(frame(spark, rows), **sizes).collect()}
    want = brute([r[:2] for r in rows])
    assert got == want and sum(v[0] is not None for v in want.values()) > 10 and len(want) > 60


def test_awkward_rows(spark):
    rows = awkward_rows() + [(100 + i, "zürich zurich zürichs ÀÉÎõü × ÷÷÷÷÷÷ straße STRASSE straßen " * 3 + "Āzurichx", None, None, 0, "", "", 0)
                             for i in range(120)] + [(None, "zurichs zurichs zurichs", None, None, 0, "", "", 0)]
    out = spelling.group_variants(frame(spark, rows))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in out.collect()}
    assert got == brute([r[:2] for r in rows])
    assert {"zürich", "÷÷÷÷÷÷", "x" * 5000} & set(got) == {"zürich", "÷÷÷÷÷÷"}


def test_long_words_and_deletions(spark):
    long = "ab" * 4000
    rows = [(i, " ".join([long, long + "c", long[1:], "plain" + "s" * (i % 2)]), "", "", 0, "", "", 0) for i in range(300)]
    got = {r.word: r.n for r in spelling.vocabulary(frame(spark, rows)).collect()}
    assert got == brute_words([r[:2] for r in rows])


def test_empty_table(spark):
    assert spelling.group_variants(empty(spark)).count() == 0
    assert spelling.group_variants(frame(spark, [(1, "the of", "", "", 0, "", "", 0)])).count() == 0


WORDS = st.lists(st.text("abcé", min_size=1, max_size=7), min_size=1, max_size=30, unique=True)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.text("abcé", max_size=6))
def test_intervals_count_occurrences(words, pattern):
    index = spelling.Bidirectional(words)
    body = "\n" + "\n".join(words) + "\n"
    state = index.whole(1)
    for k in range(len(pattern)):
        symbol = np.array([spelling._SYMBOL[ord(pattern[-1 - k])]])
        state = index.extend_left(symbol, state)
        part = pattern[len(pattern) - 1 - k:]
        times = sum(body.startswith(part, i) for i in range(len(body)))
        low, high, back_low, back_high = (int(x[0]) for x in state)
        assert high - low == times == back_high - back_low
        if not times:
            break
        assert all(body.startswith(part, i) for i in index.left.places[low:high])
        assert all(body[::-1].startswith(part[::-1], i) for i in index.right.places[back_low:back_high])


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS, st.integers(0, 7))
def test_search_finds_each_word_once(words, questions, exact):
    index = spelling.Bidirectional(words)
    sizes = np.minimum([len(q) for q in questions], exact)
    for kind in (spelling.LONGER, spelling.EQUAL, spelling.SHORTER):
        q, w = spelling.near_words(index, questions, sizes, np.full(len(questions), kind))
        got = sorted((questions[i], words[j]) for i, j in zip(q.tolist(), w.tolist()))
        want = sorted((a, b) for a, e in zip(questions, sizes.tolist()) for b in words
                      if len(b) - len(a) == kind and b.startswith(a[:e]) and one_apart(a, b) and changed_behind(a, b, e))
        assert got == want


def changed_behind(a, b, e):
    """One letter can be changed behind the first ``e`` of ``a``."""
    if len(a) == len(b):
        return a[:e] == b[:e]
    if len(a) < len(b):
        return any(b[:i] + b[i + 1:] == a for i in range(e, len(b)))
    return any(a[:i] + a[i + 1:] == b for i in range(e, len(a)))


def test_checksums():
    runs = [b"a", b"hello", "ÀÉÎ".encode(), b"x" * 300]
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(r) for r in runs])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(4)], np.uint32)
    got = spelling.checksums(data, ends - [len(r) for r in runs], ends, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + r) for i, r in enumerate(runs)]


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.oracle_sql()["op13_spelling_variants"]).fetchall()
    got = queries.queries()["op13_spelling_variants"](spark, SF)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 100
