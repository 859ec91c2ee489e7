"""Spelling variants: a bidirectional FM-index search, either half exact and the other with one error.

*Words.* Tasks find runs of letters in whole texts, lower-case A-Z, delete a
letter where the run's checksum asks for it, and count in a bounded table; Spark
sums the counts. Words are results of at least LEAST_LETTERS letters and
LEAST_TIMES occurrences.

*Buckets.* If two words differ by one letter, one of them has its left half at
the other's beginning, or its right half at the other's end. So each word is
indexed twice, by its beginning and (reversed) by its end: bucket
(side, length, first letters), as many letters as every word that may look
there knows exactly. A word asks six buckets: both sides, for words one letter
longer, of equal length, and one shorter. A bucket beyond BLOCK_WORDS is cut
into blocks by hash and each of its questions goes to all of them, so a hot
beginning needs no larger task.

*Search.* A block's words, delimited, make one text with an FM-index of the
text and of its reverse. A question's exact half is grown leftwards from its
middle to the delimiter, with the matching interval of the reversed text kept
in step; from there it is extended rightwards over the other half with one
error, and to the delimiter. Intervals are of suffix ranks; a step is two binary
searches in the sorted (letter, place) pairs. All questions of a batch go step
by step together.

*Forms.* Per word: how many near words, and the most frequent one. Roots follow
forms by pointer doubling; frequencies at least double on the way, so at most 63
forms follow one another.

Null texts have no words; with a null id no letter is deleted. Rows are
documents, repeated rows count again. An empty table gives no row. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_slices, word_hashes, written

LEAST_LETTERS, LEAST_TIMES = 5, 3
EVERY = 97                 # a run whose checksum is a multiple loses a letter
FORM_TIMES = 2             # a form is at least so much more frequent
HELD_WORDS = 300_000       # distinct words counted in a task before they are passed on
BLOCK_WORDS = 16_384       # words of one index
BATCH = 4096               # questions searched together

_U = np.uint64
_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
DELIMITER = 1              # symbol of the delimiter; letters follow, 0 ends the text
_SYMBOL = np.zeros(0x100, np.int64)
_SYMBOL[_LETTERS] = np.arange(2, 2 + len(_LETTERS))
SYMBOLS = 2 + len(_LETTERS)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def letter_runs(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run of letters; U+00C0..U+00FF are the byte C3 and one after it."""
    inside = _ALPHA[data]
    lead = data == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = cut[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run continued from ``before`` (the checksum of what precedes it), all runs byte by byte."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live, k = np.arange(len(starts)), 0
    while len(live):
        live = live[starts[live] + k < ends[live]]
        own = state[live]
        state[live] = _CRC[(own ^ data[starts[live] + k]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
        k += 1
    return state ^ np.uint32(0xFFFFFFFF)


def _runs_counted(ids: list, data: np.ndarray, cut: np.ndarray, counts: Counter) -> None:
    data = _LOWER[data]
    starts, ends = letter_runs(data, cut)
    after = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=after[1:])
    letters = after[ends] - after[starts]
    some = letters >= LEAST_LETTERS
    starts, ends, letters = starts[some], ends[some], letters[some]
    if not len(starts):
        return
    row = np.searchsorted(cut, starts, "right") - 1
    prefix = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in ids], np.uint32)
    known = np.array([i is not None for i in ids])
    sums = checksums(data, starts, ends, prefix[row])
    hit = (sums % np.uint32(EVERY) == 0) & known[row]
    raw = data.tobytes()
    for s, e, n, h in zip(starts[hit].tolist(), ends[hit].tolist(), letters[hit].tolist(), sums[hit].tolist()):
        word = raw[s:e].decode()
        at = h % n
        if n > LEAST_LETTERS:
            counts[(word[:at] + word[at + 1:]).encode()] += 1
    starts, ends = starts[~hit], ends[~hit]
    _, first, times = np.unique(word_hashes(data, starts, ends, False), return_index=True, return_counts=True)
    for s, e, n in zip(starts[first].tolist(), ends[first].tolist(), times.tolist()):
        counts[raw[s:e]] += n


def _count(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, end, data, cut in text_slices(batch.column("text")):
                _runs_counted(ids[first:end], data, cut, counts)
                if len(counts) >= held:
                    yield flush()
        if counts:
            yield flush()
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = HELD_WORDS) -> DataFrame:
    """(word, n) of the words of all texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = map_arrow(rows, _count(held), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


class FMIndex:
    """Suffix ranks of one text: intervals of rows that begin with a pattern, extended at its left."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        # Ranks by ever longer beginnings; `depth` letters are enough for patterns of at most `depth`.
        n = len(text)
        rank, known = text.astype(np.int64), 1
        while True:
            later = np.zeros(n, np.int64)
            later[: n - known] = rank[known:] + 1
            key = rank * (int(rank.max()) + 3) + later
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[1:] = np.cumsum(key[order][1:] != key[order][:-1])
            rank[order] = new
            known *= 2
            if known >= depth or new[-1] == n - 1:
                break
        self.places, self.n = order, n
        before = text[order - 1].astype(np.int64)  # the symbol in front of each row's suffix, cyclic
        self.sorted = np.sort(before * (n + 1) + np.arange(n))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of ``symbol`` and the pattern of [low, high): rows of smaller symbols and earlier places."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.sorted, base + low), np.searchsorted(self.sorted, base + high)


class Bidirectional:
    """Index of delimited words and of the reversed text."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        body = "\n" + "\n".join(words) + "\n"  # a line feed is no letter
        codes = np.frombuffer(body.encode("utf-32-le"), np.uint32)
        text = np.where(codes == 10, DELIMITER, _SYMBOL[codes & 0xFF])
        depth = max(map(len, words)) + 3
        self.left = FMIndex(np.append(text, 0), depth)
        back = np.append(text[::-1], 0)
        self.right = FMIndex(back, depth)
        # The word that ends at a delimiter: delimiters are counted from the right in the reversed text.
        ends = len(words) - np.cumsum(back == DELIMITER)
        self.word_of_row = ends[self.right.places]
        self.alphabet = np.unique(text)

    def whole(self, n: int) -> tuple:
        """Intervals (left low, left high, right low, right high) of the empty pattern."""
        return (np.zeros(n, np.int64), np.full(n, self.left.n, np.int64),
                np.zeros(n, np.int64), np.full(n, self.right.n, np.int64))

    def extend_left(self, symbol: np.ndarray, state: tuple) -> tuple:
        """Both intervals of ``symbol`` + pattern; the reversed one moves past its rows of smaller symbols."""
        low, high, back, _ = state
        smaller = np.concatenate([[0], self.alphabet])  # 0 ends the text
        grid_low, grid_high = self.left.step(smaller[:, None], low[None], high[None])
        less = np.where(smaller[:, None] < symbol[None], grid_high - grid_low, 0).sum(0)
        low, high = self.left.step(symbol, low, high)
        return low, high, back + less, back + less + high - low

    def exact_halves(self, halves: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Intervals in the reversed text of delimiter + half, grown from the half's end."""
        n = len(halves)
        state, sizes = self.whole(n), np.array([len(h) for h in halves])
        symbols = _padded([h[::-1] for h in halves])
        symbols = np.concatenate([symbols, np.zeros((n, 1), np.int64)], 1)
        symbols[np.arange(n), sizes] = DELIMITER
        for k in range(symbols.shape[1]):
            live = np.flatnonzero((k <= sizes) & (state[1] > state[0]))
            if not len(live):
                break
            new = self.extend_left(symbols[live, k], tuple(x[live] for x in state))
            for x, y in zip(state, new):
                x[live] = y
        return state[2], state[3]


def _padded(words: list[str]) -> np.ndarray:
    """Symbols of the words, one per row, zeros behind."""
    width = max(map(len, words), default=0)
    if not width:
        return np.zeros((len(words), 0), np.int64)
    codes = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    return _SYMBOL[codes & 0xFF]


LONGER, EQUAL, SHORTER = 1, 0, -1  # the words asked for have one letter more, as many, one less


def near_words(index: Bidirectional, questions: list[str], exact: np.ndarray, kind: np.ndarray) -> tuple:
    """(question, word) numbers of indexed words that begin with the question's first ``exact`` letters and differ by
    one letter behind them: one inserted (LONGER), replaced (EQUAL) or deleted (SHORTER)."""
    n = len(questions)
    sizes = np.array([len(q) for q in questions])
    halves = [q[:e] for q, e in zip(questions, exact.tolist())]
    names = {h: i for i, h in enumerate(dict.fromkeys(halves))}
    low, high = index.exact_halves(list(names))
    of = np.array([names[h] for h in halves])
    symbols = np.concatenate([_padded(questions), np.zeros((n, 1), np.int64)], 1)
    symbols[np.arange(n), sizes] = DELIMITER
    letters = index.alphabet[index.alphabet > DELIMITER]

    # One error: (question, next letter to match, interval) once it is made.
    spent = []
    q = np.flatnonzero(high[of] > low[of])
    at, low, high = exact[q].copy(), low[of[q]], high[of[q]]
    while len(q):
        end = sizes[q]
        # Deleting any letter of a run gives the same word: the run's last one stands for all.
        gone = (kind[q] == SHORTER) & (at < end)
        gone[gone] &= symbols[q[gone], at[gone]] != symbols[q[gone], at[gone] + 1]
        spent.append((q[gone], at[gone] + 1, low[gone], high[gone]))
        other = ((kind[q] == EQUAL) & (at < end)) | ((kind[q] == LONGER) & (at <= end))
        if other.any() and len(letters):
            own, place = q[other], at[other]
            a, b = index.right.step(letters[:, None], low[other][None], high[other][None])
            # A letter before its like is the same word as one behind it: only the latter is made.
            some = (b > a) & (letters[:, None] != symbols[own, place][None])
            c, i = np.nonzero(some)
            spent.append((own[i], place[i] + (kind[own[i]] == EQUAL), a[c, i], b[c, i]))
        live = at < end
        q, at, low, high = q[live], at[live], low[live], high[live]
        low, high = index.right.step(symbols[q, at], low, high)
        live = high > low
        q, at, low, high = q[live], at[live] + 1, low[live], high[live]

    # What is left of the questions, exactly, and the delimiter.
    found_q, found_w = [], []
    q, at, low, high = (np.concatenate([s[k] for s in spent]) for k in range(4)) if spent else (np.zeros(0, np.int64),) * 4
    while len(q):
        low, high = index.right.step(symbols[q, at], low, high)
        live = high > low
        q, at, low, high = q[live], at[live], low[live], high[live]
        done = at == sizes[q]
        found_q.append(q[done])
        found_w.append(index.word_of_row[low[done]])
        q, at, low, high = q[~done], at[~done] + 1, low[~done], high[~done]
    return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (np.zeros(0, np.int64),) * 2


_CELL = ["bucket", "block"]


def _search(batch: int):
    """Rows sorted by (bucket, block, role): a block's words (role 0), then its questions."""
    def answer(index: Bidirectional, times: np.ndarray, rows: list[tuple]) -> pa.RecordBatch:
        side = np.array([r[1] for r in rows])
        kind = np.array([r[2] for r in rows])
        asked = [r[0][::-1] if r[1] else r[0] for r in rows]
        sizes = np.array([len(w) for w in asked])
        exact = np.where(side == 0, sizes // 2, sizes - sizes // 2)
        q, w = near_words(index, asked, exact, kind)
        # Found from its end: not if the left half stands at the beginning too, where it is found already.
        words, names, near = [], [], []
        for i, j in zip(q.tolist(), w.tolist()):
            word = rows[i][0]
            other = index.words[j]
            if side[i]:
                other = other[::-1]
                if other.startswith(word[: len(word) // 2]):
                    continue
            words.append(word)
            near.append(other)
            names.append(int(times[j]))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.string()),
                                           pa.array(names, pa.int64())], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, index, words, times, asked = None, None, [], [], []
        for part in batches:
            columns = [part.column(c).to_pylist() for c in ("bucket", "block", "role", "word", "n", "side", "kind")]
            for bucket, block, role, word, n, side, kind in zip(*columns):
                if (bucket, block) != cell:
                    if asked and index:
                        yield answer(index, np.array(times), asked)
                    cell, index, words, times, asked = (bucket, block), None, [], [], []
                if role == 0:
                    words.append(word[::-1] if side else word)
                    times.append(n)
                elif words:
                    index = index or Bidirectional(words)
                    asked.append((word, side, kind))
                    if len(asked) >= batch:
                        yield answer(index, np.array(times), asked)
                        asked = []
        if asked and index:
            yield answer(index, np.array(times), asked)
    return run


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS, batch: int = BATCH) -> DataFrame:
    """(word, near, near_n): every ordered pair of ``words`` (word, n) that differ by one letter, once."""
    total = words.count()
    buckets = max(1, -(-2 * total // block_words))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")

    def bucket(length, side: str = "side"):
        # Letters that every word of length - 1 .. length + 1 knows exactly at that side.
        known = F.when(F.col(side) == 0, F.floor((length - 1) / 2)).otherwise(F.floor(length / 2)).cast("int")
        turned = F.when(F.col(side) == 0, F.col("word")).otherwise(F.reverse("word"))
        return F.pmod(F.xxhash64(F.col(side), length, F.substring(turned, F.lit(1), known)), F.lit(buckets))

    indexed = words.select("word", "n", sides).withColumn("bucket", bucket(F.length("word")))
    asked = (words.select("word", "n", sides)
             .select("*", F.explode(F.array(*map(F.lit, (LONGER, EQUAL, SHORTER)))).alias("kind"))
             .filter(F.length("word") + F.col("kind") >= LEAST_LETTERS)
             .withColumn("bucket", bucket(F.length("word") + F.col("kind"))))
    sizes = written(indexed.groupBy("bucket", "side").count()
                    .select("bucket", "side", F.ceil(F.col("count") / block_words).cast("int").alias("blocks")),
                    "spelling-buckets")
    rows = ["bucket", "block", "role", "word", "n", "side", "kind"]
    held = (indexed.join(sizes, ["bucket", "side"])
            .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
            .select("bucket", "block", F.lit(0).alias("role"), "word", "n", "side", F.lit(0).alias("kind")))
    asked = (asked.join(sizes, ["bucket", "side"])
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", "block", F.lit(1).alias("role"), "word", "n", "side", "kind"))
    # A cell holds one side's words.
    cells = (held.unionByName(asked).withColumn("bucket", F.col("bucket") * 2 + F.col("side"))
             .repartition(int(min(4 * buckets + 8, 20_000)), "bucket", "block")
             .sortWithinPartitions("bucket", "block", "role", "word"))
    return map_arrow(cells.select(*rows), _search(batch), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form), form null at the end of a chain."""
    links = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("next")), "spelling-links")
    # A root has no link; each round every link skips as far as it has come.
    for _ in range(7):
        further = links.select(F.col("word").alias("next"), F.col("next").alias("after"))
        new = written(links.join(further, "next", "left")
                      .select("word", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("moved")),
                      "spelling-links")
        links = new.select("word", "next")
        if new.filter("moved").isEmpty():
            break
    return forms.select("word").join(links, "word", "left").select("word", F.coalesce("next", "word").alias("root"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS,
                   batch: int = BATCH, held: int = HELD_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, id_col, text, held), "spelling-words")
    near = (near_pairs(words, block_words, batch).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.max("near_n").alias("most"),
                 F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    joined = words.join(near, "word", "left")
    enough = F.col("most") >= FORM_TIMES * F.col("n")
    forms = written(joined.select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("most")).alias("form_n")), "spelling-forms")
    return (forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n"))


# Near words by joins of words that have a letter deleted; checksums bit by bit.
SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS code FROM counted),
summed AS (
  SELECT run, n, doc_id, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(code) // 2), lambda i:
      [('0x' || substr(code, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))) AS state
  FROM coded),
changed AS (
  SELECT CASE WHEN doc_id IS NOT NULL AND xor(state, 4294967295::BIGINT) % 97 = 0
              THEN substr(run, 1, xor(state, 4294967295::BIGINT) % length(run))
                   || substr(run, xor(state, 4294967295::BIGINT) % length(run) + 2) ELSE run END AS word, n
  FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.part = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, (-n, near)) AS form FROM near GROUP BY word),
forms AS (
  SELECT words.word, CASE WHEN most >= 2 * words.n THEN form END AS form, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN most >= 2 * words.n THEN most END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
chain AS (
  SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.here AND forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
