import base64
import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import awkward_rows, empty, frame
from trendlens.llm import bpe, chunks, packing
from trendlens.llm.chunk_table import ChunkTable
from trendlens.llm.chunks import ChunkCache

RANKS = bpe.read_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
VOCABULARY = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
JSON = bpe.read_file(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=1)
def _library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_buffer(JSON)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.text(alphabet="abth eing'sé\n\t ñ日🙂12.,", max_size=300))
def test_encoding_equals_the_library(text):
    ids = np.frombuffer(VOCABULARY.encode_texts([text])[0], "<u4").tolist()
    assert ids == _library().encode_ordinary(text)
    assert VOCABULARY.decode(ids) == text.encode()
    cut = np.frombuffer(b"".join(VOCABULARY.encode_texts(chunks.chunks_of(text))), "<u4").tolist()
    assert cut == ids and "".join(chunks.chunks_of(text)) == text


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 3000])
def test_long_pieces_and_ties(n):
    for piece in ("a" * n, "th" * n, ("é" * n)):
        assert np.frombuffer(VOCABULARY.encode_pieces([piece.encode()])[0], "<u4").tolist() == \
            _library()._encode_single_piece(piece)


def test_cache_of_any_size_gives_the_same_ids():
    texts = ["one two three", "two three four ", "", "x" * 500 + " y", "a  b"] * 3
    whole = VOCABULARY.encode_texts(texts)
    encode = lambda pieces: VOCABULARY.encode_pieces([p.encode() for p in pieces])
    for entries in (1, 3, 1000):
        cache = chunks.ChunkCache(encode, public_tokenizers.PATTERN, entries)
        assert [x for t in texts for x in cache.of_texts([t])] == list(cache.of_texts(texts)) == whole


def test_documents_round_trip(spark):
    rows = awkward_rows()
    coded = bpe.encode_documents(frame(spark, rows), RANKS, public_tokenizers.PATTERN, with_ids=True)
    expected = sorted((r[0] if r[0] is not None else -1, hashlib.sha256(
        ",".join(map(str, _library().encode_ordinary(r[1] or ""))).encode()).hexdigest(),
        hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids_sha256, r.decoded_sha256) for r in coded.collect())
    assert got == expected
    texts = bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r.text for r in texts) == sorted(r[1] or "" for r in rows)


def test_empty_tables(spark):
    assert bpe.encode_documents(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack_documents(empty(spark), JSON).count() == 0


@pytest.mark.parametrize("size,windows,fan", [(1024, 16, 64), (16, 2, 2), (1, 1, 2), (100, 3, 2)])
def test_packing(spark, tokenizer, size, windows, fan):
    rows = [(i, r[1]) for i, r in enumerate(awkward_rows()) if size > 16 or len(r[1] or "") < 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pieces = packing.pack_documents(docs, JSON, size=size, windows=windows, fan=fan).toPandas()
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = pieces[pieces.doc_id == i].sort_values("start")
        at = 0
        for p in mine.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at: at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
        total = s.length.sum()
        assert total <= size and (total == size or total & (total - 1) == 0)


def test_added_tokens_in_texts_are_the_librarys(spark):
    unmodified = Tokenizer.from_buffer(JSON)
    rows = [(0, "one <|endoftext|> two"), (1, "<|endoftext|>"), (2, "a  <|endoftext|><|endoftext|>\n b"),
            (3, "no <|endoftext| > here"), (4, "plain text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack_documents(docs, JSON, size=1024).toPandas()
    for i, text in rows:
        ids = np.array(unmodified.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (50256 in ids) == (i < 3)
        mine, at = pieces[pieces.doc_id == i].sort_values("start"), 0
        for p in mine.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at: at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_windows_are_bounded_and_best_fit():
    packer = packing.Packer(10, 2, 0)
    out = []
    for doc, n in enumerate([6, 7, 3, 2, 9, 9, 1]):
        out += packer.add(doc, 0, np.arange(n), n)
        assert len(packer.open) <= 2
    assert [o[0] for o in out[:2]] == [1, 2]     # 3 fits 7 exactly: best fit
    assert sum(len(o[2]) for o in out) + sum(len(p[2]) for p in packer.rest()) == 37


@pytest.mark.parametrize("entries,pool", [(1 << 12, 1 << 20), (64, 1 << 20), (1 << 12, 50), (4, 10)])
def test_table_gives_what_the_cache_gives(entries, pool):
    vocabulary = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    encode = lambda pieces: vocabulary.encode_pieces([p.encode() for p in pieces])
    table = ChunkTable(encode, entries=entries, pool_ids=pool)
    rng = np.random.default_rng(entries)
    words = ["the", "of", "é", "日本", "x" * 300, "a\nb", "don't", "12", "?!", " z", "\x1f", "tail\n"]
    for _ in range(5):
        texts = [None, "", " ", "  a", " lead", "a ", "a  b", "\t x"]
        texts += [" ".join(rng.choice(words, rng.integers(1, 40)).tolist() + [str(rng.integers(0, 500))]) for _ in range(60)]
        rng.shuffle(texts)
        column = pa.array(texts, pa.string())
        for part in (column, column.slice(3, 40)):
            got = [x.tobytes() for x in table.of_column(part)]
            assert got == list(ChunkCache(encode).of_texts([t or "" for t in part.to_pylist()]))
        assert table.known <= entries


def test_table_keeps_few_pieces_beside_its_own():
    """A worker that keeps each piece twice, and arrays for 1 MB of text, takes 130 MB more."""
    asked, sizes = [], []
    table = ChunkTable(lambda pieces: [asked.append(len(pieces)) or b"\1\0\0\0"] * len(pieces))
    entries_of = table._entries_of
    table._entries_of = lambda data, starts, ends: sizes.append(len(data)) or entries_of(data, starts, ends)
    texts = [" ".join(f"w{'abcdefghij'[i % 10]}{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(a, a + 2000))
             for a in range(0, 200_000, 2000)]
    for _ in range(2):
        assert sum(map(len, table.of_column(pa.array(texts)))) == 200_000
    pieces = table.cache.pieces
    assert len(pieces.known) + len(pieces.old) < 120_000 and table.known > 190_000
    assert max(sizes) <= 1 << 18
