"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features describe the line and its
two neighbours; transitions join adjacent lines. Weights are learned from
documents with a quality label, all of whose lines take that label, by
gradient ascent on the exact conditional likelihood (forward-backward) with an
L2 penalty. A document's score is the mean of its lines' marginal
probabilities of being good, weighted by line length.

Training uses all lines of at most ``most_docs`` labelled documents (those with
the least hash of their id); fewer whole documents if their lines would be more
than ``most_lines`` together, and none that has more than that alone. That
bounded sample is all that reaches the driver. Scoring reads whole texts where they
lie, with the weights broadcast (a few hundred numbers); the features of a
slice of texts are computed together over its bytes.

Held out: rows whose CRC-32 of the id as text has remainder 2 by 4; they are
never trained on. Label, language, source and id are no inputs of a score.
Null and empty texts, which have no line, score the share of good training
documents. Rows with equal ids are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, byte_class, gram_hashes, map_arrow, text_slices, word_bounds, word_hashes, written

MOST_DOCS = 4000
MOST_LINES = 800_000   # of all training documents together
ROUNDS = 200
GOOD = 0.7   # score from which a document counts as good

_LINE = ~byte_class(b"\n")
_WORD = ~byte_class(SPACE_BYTES)
_CLASSES = {
    "symbol": byte_class(b"#*$%&|<>{}[]\\^~_="),
    "digit": byte_class(b"0123456789"),
    "upper": byte_class(bytes(range(0x41, 0x5B))),
    "stop": byte_class(b".!?"),
    "punct": byte_class(b",;:'\"()-/"),
    "high": byte_class(bytes(range(0x80, 0x100))),
    "space": byte_class(SPACE_BYTES),
}
OWN = (*_CLASSES, "log_bytes", "log_words", "word_bytes", "different", "repeated_grams", "repeated_line", "ends",
       "first", "last")
N_FEATURES = 3 * len(OWN) + 1


def _shares(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per element: how often its (group, key) occurs."""
    both = keys ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    return counts[inverse]


def line_features(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features per line that holds a word, the line's bytes, and ``first``: text i has lines first[i]:first[i+1]."""
    starts, ends, _ = word_bounds(data, cut, _LINE)
    w_starts, w_ends, _ = word_bounds(data, cut, _WORD)
    # Words belong to the line they start in; lines without a word are left out.
    n_words = np.searchsorted(w_starts, ends) - np.searchsorted(w_starts, starts)
    starts, ends, n_words = starts[n_words > 0], ends[n_words > 0], n_words[n_words > 0]
    first = np.searchsorted(starts, cut)
    size = (ends - starts).astype(np.float64)
    columns = {}
    for name, table in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        columns[name] = (total[ends] - total[starts]) / np.maximum(size, 1)
    columns["log_bytes"] = np.log1p(size)
    columns["log_words"] = np.log1p(n_words)
    columns["word_bytes"] = np.log1p(size / np.maximum(n_words, 1))

    hashes = word_hashes(data, w_starts, w_ends)
    line_of = np.repeat(np.arange(len(starts)), n_words)
    text_of_line = np.repeat(np.arange(len(cut) - 1), np.diff(first))
    if len(hashes):
        columns["different"] = np.bincount(line_of, 1.0 / _shares(hashes, line_of), len(starts)) / n_words
        grams = np.concatenate([gram_hashes(hashes, 3), hashes[-2:]])[: len(hashes)]
        text_of = text_of_line[line_of]
        inside = np.zeros(len(hashes), bool)
        inside[:-2] = text_of[:-2] == text_of[2:]
        again = (_shares(grams, text_of) > 1) & inside
        columns["repeated_grams"] = np.bincount(line_of, again, len(starts)) / n_words
        lines = word_hashes(data, starts, ends, fold_ascii=False)
        columns["repeated_line"] = (_shares(lines, text_of_line) > 1).astype(np.float64)
        columns["ends"] = _CLASSES["stop"][data[ends - 1]].astype(np.float64)
    else:
        columns |= {k: np.zeros(len(starts)) for k in ("different", "repeated_grams", "repeated_line", "ends")}
    is_first, is_last = np.zeros(len(starts)), np.zeros(len(starts))
    some = np.diff(first) > 0
    is_first[first[:-1][some]] = 1
    is_last[first[1:][some] - 1] = 1
    columns["first"], columns["last"] = is_first, is_last
    own = np.column_stack([columns[name] for name in OWN]) if len(starts) else np.zeros((0, len(OWN)))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * (1 - is_first[1:, None])
    after[:-1] = own[1:] * (1 - is_last[:-1, None])
    return np.column_stack([own, before, after, np.ones(len(starts))]), size, first


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray      # of "good" against "bad", per feature
    moves: np.ndarray        # 2 x 2: from line state to next line state (0 bad, 1 good)
    prior: float             # share of good documents

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6) @ self.weights


def _runs(first: np.ndarray, most: int = 256) -> Iterator[np.ndarray]:
    """Texts with lines, by number of lines, in groups of similar length."""
    counts = np.diff(first)
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    a = 0
    while a < len(order):
        b = min(len(order), a + most)
        limit = 2 * counts[order[a]] + 8
        b = a + max(1, int(np.searchsorted(counts[order[a:b]], limit, "right")))
        yield order[a:b]
        a = b


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(good) of every line by forward-backward; with ``pairs`` also log Z and expected transitions.

    ``scores`` are the lines' log-odds of good.
    """
    good = np.zeros(len(scores))
    log_z, expected = 0.0, np.zeros((2, 2))
    step = np.exp(moves - moves.max())
    for texts in _runs(first):
        counts = first[texts + 1] - first[texts]
        n, t = len(texts), int(counts.max())
        at = first[texts][:, None] + np.arange(t)
        live = np.arange(t) < counts[:, None]
        odds = np.where(live, scores[np.minimum(at, len(scores) - 1)], 0.0)
        # Log-odds s: weights exp(min(0, -s)) for bad and exp(min(0, s)) for good, each step normalised.
        emit = np.stack([np.exp(np.minimum(0, -odds)), np.exp(np.minimum(0, odds))], -1)
        forward = np.empty((n, t, 2))
        norm = np.ones((n, t))
        forward[:, 0] = emit[:, 0]
        norm[:, 0] = forward[:, 0].sum(1)
        forward[:, 0] /= norm[:, 0, None]
        for i in range(1, t):
            x = (forward[:, i - 1] @ step) * emit[:, i]
            norm[:, i] = x.sum(1)
            forward[:, i] = x / norm[:, i, None]
        backward = np.ones((n, t, 2))
        for i in range(t - 2, -1, -1):
            x = (backward[:, i + 1] * emit[:, i + 1]) @ step.T / norm[:, i + 1, None]
            backward[:, i] = np.where(live[:, i + 1, None], x, 1.0)
        both = forward * backward
        p = both[:, :, 1] / both.sum(2)
        good[at[live]] = p[live]
        if pairs:
            inner = live[:, 1:]
            log_z += float(np.log(norm[live]).sum() + np.maximum(0, odds[live]).sum() + inner.sum() * moves.max())
            joint = (forward[:, :-1, :, None] * step[None, None] * (emit[:, 1:] * backward[:, 1:])[:, :, None, :]
                     / norm[:, 1:, None, None])
            expected += joint[inner].sum(0)
    return (good, log_z, expected) if pairs else good


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS,
          penalty: float = 1e-3, rate: float = 0.1) -> Model:
    """Weights by Adam on the conditional log-likelihood of the line states (all of a text's lines take its label)."""
    mean, scale = features.mean(0), features.std(0)
    mean[-1], scale = 0.0, np.where(scale < 1e-6, 1.0, scale)
    x = np.clip((features - mean) / scale, -6, 6)
    counts = np.diff(first)
    state = np.repeat(labels, counts).astype(np.float64)
    n, kept = len(x), np.zeros((2, 2))
    steps = np.maximum(counts - 1, 0)
    kept[1, 1], kept[0, 0] = steps[labels == 1].sum(), steps[labels == 0].sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, _, expected = marginals(x @ w, first, moves, pairs=True)
        gradient = np.concatenate([x.T @ (state - good), (kept - expected).ravel()]) / n - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta = theta + rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), float(labels.mean()) if len(labels) else 0.5)


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Score of each text of an Arrow column."""
    out = []
    for _, _, data, cut in text_slices(column, 1 << 20):
        features, size, first = line_features(data, cut)
        good = marginals(model.emissions(features), first, model.moves) if len(features) else np.zeros(0)
        weight = np.concatenate([[0.0], np.cumsum(size)])
        total = np.concatenate([[0.0], np.cumsum(size * good)])
        size_of, good_of = np.diff(weight[first]), np.diff(total[first])
        out.append(np.where(size_of > 0, good_of / np.maximum(size_of, 1), model.prior))
    return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def is_held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        most_docs: int = MOST_DOCS, most_lines: int = MOST_LINES) -> Model:
    """Model from at most ``most_docs`` whole labelled documents that are not held out."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
              .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("id")))
              .dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most_docs))
    # At most most_docs ids: a bounded broadcast. Written, because both passes must see the same rows.
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(chosen), "id").dropDuplicates(["id"]), "crf-sample")

    def run(with_features: bool):
        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, counts = [], []
                for _, _, data, cut in text_slices(batch.column("text")):
                    features, _, first = line_features(data, cut)
                    counts.extend(np.diff(first).tolist())
                    if with_features:
                        raw += [features[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])]
                columns = [batch.column("id"), batch.column("label"), pa.array(counts, pa.int32())]
                names = ["id", "label", "lines"]
                if with_features:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "features"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        return of_batches

    fields = "id long, label int, lines int"
    sizes = map_arrow(sample, run(False), fields).orderBy(F.xxhash64("id"), "id").toArrow()
    ids, lines = sizes.column("id").to_numpy(), sizes.column("lines").to_numpy().astype(np.int64)
    ids, lines = ids[lines <= most_lines], lines[lines <= most_lines]
    ids = ids[np.cumsum(lines) <= most_lines].tolist()
    if len(ids) < sizes.num_rows:
        fitting = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
        sample = sample.join(F.broadcast(fitting), "id")
    rows = map_arrow(sample, run(True), fields + ", features binary").orderBy("id").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)), 0.5)
    features = np.frombuffer(b"".join(rows.column("features").to_pylist()), "<f4").reshape(-1, N_FEATURES)
    first = np.concatenate([[0], np.cumsum(rows.column("lines").to_numpy())])
    return train(features.astype(np.float64), first, rows.column("label").to_numpy())


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()),
                 pa.array(score >= GOOD, pa.bool_()).cast(pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"),
                        F.col(text).cast("string").alias("text"))
    return map_arrow(plain, run, "doc_id long, held_out boolean, score double, predicted int")
