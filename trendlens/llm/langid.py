"""Language of documents and pages by Bayesian fusion of evidence.

* Text: naive Bayes over hashed byte trigrams, counted over all documents with
  a usable ``lang`` by grouped aggregation (BUCKETS counts per language).
* Declared language (``<html lang>`` of a page, ``lang`` of a document): the
  text posteriors of all other records that declare the same, of both kinds,
  smoothed towards a prior that gives the declared language the agreement rate
  learned from all records, and the others the rest.
* Address suffix (the last label of the host): the text posteriors of all other
  records under it, smoothed towards the languages that those declare.
* Host prior: shares of the languages among a host's records, smoothed towards
  those of its domain, which are smoothed towards the global ones.

What a record's own text says is taken out of these sums, so that it counts
once. They are sums grouped by declared language, suffix, domain and host.
Partial sums keep a hot host cheap; records meet their host's row by a shuffled
join, which Spark splits where a host is hot. Scores, posteriors and sums are
arrays with one entry per language. Only the trigram counts and one row per
language reach the driver: BUCKETS numbers for each of the MOST_LANGUAGES
languages with the most labelled text, whatever the input; a language beyond
them is never the answer (as a declaration it says nothing).

Null and empty texts have no text evidence; a missing host, suffix or
declaration adds none. Rows are records: repeated ids or rows are judged each.
Ties go to the language first in the alphabet. Without any labelled document
the language is null and the probability 0. Empty tables give no row; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_slices, written

BUCKETS = 1 << 13
SMOOTH = 500.0     # trigrams that the global shares count for in each language
PULL = 5.0         # records that the level above counts for
MOST_LANGUAGES = 200
TEMPER = 1 / 3     # each byte is in three trigrams

_LANGUAGE = re.compile(r"[a-z]{2,3}\Z")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[*range(0x30, 0x3A)]] = 0x30      # all digits alike
_FOLD[[*range(0x09, 0x0E)]] = 0x20


def language_code(raw: str | None) -> str | None:
    """Primary subtag of a language tag, or None."""
    code = re.split(r"[-_]", (raw or "").strip().lower(), maxsplit=1)[0]
    return code if _LANGUAGE.match(code) else None


def buckets_of(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram that lies within a text, and its text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[data].astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    bucket = (code * np.uint32(0x9E3779B1) >> np.uint32(32 - 13)).astype(np.int64)
    counts = np.diff(cut)
    text_of = np.repeat(np.arange(len(counts)), counts)
    inside = text_of[:-2] == text_of[2:]
    return bucket[inside], text_of[:-2][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of the task's documents, per language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        codes = [language_code(c) for c in batch.column("lang").to_pylist()]
        for first, end, data, cut in text_slices(batch.column("text")):
            bucket, text_of = buckets_of(data, cut)
            for code in sorted({c for c in codes[first:end] if c}):
                mine = np.array([c == code for c in codes[first:end]])
                counts = np.bincount(bucket[mine[text_of]], minlength=BUCKETS)
                total[code] = total[code] + counts if code in total else counts
    for code, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([code] * len(some), pa.string()), pa.array(some, pa.int64()),
                                          pa.array(counts[some], pa.int64())], names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    weights: np.ndarray   # (BUCKETS, languages): log-probabilities

    def scores(self, column: pa.Array) -> np.ndarray:
        """Tempered log-likelihood per text and language."""
        out = []
        for first, end, data, cut in text_slices(column):
            bucket, text_of = buckets_of(data, cut)
            score = np.zeros((end - first, len(self.languages)))
            for k in range(len(self.languages)):
                score[:, k] = np.bincount(text_of, self.weights[bucket, k], end - first)
            out.append(score * TEMPER)
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = MOST_LANGUAGES) -> TextModel:
    plain = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = written(map_arrow(plain, _count, "lang string, bucket long, n long")
                     .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid-counts")
    known = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    languages = sorted(r.lang for r in known.collect())
    counts = counts.filter(F.col("lang").isin(languages)).toArrow()
    table = np.zeros((BUCKETS, len(languages)))
    number = {code: i for i, code in enumerate(languages)}
    table[counts.column("bucket").to_numpy(), [number[c] for c in counts.column("lang").to_pylist()]] = \
        counts.column("n").to_numpy()
    everywhere = (table.sum(1, keepdims=True) + 0.5) / (table.sum() + 0.5 * BUCKETS)
    return TextModel(languages, np.log((table + SMOOTH * everywhere) / (table.sum(0) + SMOOTH)))


# ---- records ---------------------------------------------------------------

_HTML_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8}(?:[-_][A-Za-z0-9]+)*)", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str | None:
    found = _HOST.match((url or "").strip())
    return found.group(1).lower().rstrip(".") if found else None


_TAG = re.compile(r"<[A-Za-z/!?]")
_TAG_NAME = re.compile(r"</?[A-Za-z0-9]*\s*")


def visible_text(html: str) -> str:
    """Text outside tags, comments, scripts and styles; linear in the length.

    A ``<`` that opens no tag is text, and so is the rest from a tag that never ends,
    unless it is no more than the tag's name.
    """
    out, done, lower = [], 0, html.lower()
    find = lambda start: m.start() if (m := _TAG.search(html, start)) else -1
    at = find(0)
    ends = {"<script": "</script", "<style": "</style", "<!--": "-->"}
    while at >= 0:
        out.append(html[done:at])
        close = next((ends[k] for k in ends if lower.startswith(k, at)), None)
        end = lower.find(close, at) if close else at
        if end < 0:
            return " ".join(out)
        done = html.find(">", end)
        if done < 0:
            return " ".join(out if close or _TAG_NAME.fullmatch(html, at) else [*out, html[at:]])
        done += 1
        at = find(done)
    return " ".join([*out, html[done:]])


def _records(shared, pages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, text = batch.column("body"), batch.column("body")
            addresses = batch.column("address").to_pylist()
            if pages:
                raw = bodies.fill_null("").to_pylist()
                found = [_HTML_LANG.search(h[:h.find(">", max(h.lower().find("<html"), 0)) + 1]) for h in raw]
                declared = [language_code(m.group(1)) if m else None for m in found]
                text = pa.array([visible_text(h) for h in raw], pa.string())
                hosts = [host_of(u) for u in addresses]
                suffixes = [h.rsplit(".", 1)[1] if h and "." in h else None for h in hosts]
                domains = [".".join(h.split(".")[-2:]) if h else None for h in hosts]
            else:
                declared = [language_code(c) for c in batch.column("declared").to_pylist()]
                hosts = domains = addresses
                suffixes = [None] * len(hosts)
            scores = shared.value.scores(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(hosts, pa.string()), pa.array(domains, pa.string()),
                 pa.array(suffixes, pa.string()), pa.array(declared, pa.string()),
                 pa.array(list(scores), pa.list_(pa.float64()))],
                names=["id", "host", "domain", "suffix", "declared", "scores"])
    return run


def _posteriors(scores: Column) -> Column:
    """Probabilities from logarithms, whatever their common shift."""
    top = F.array_max(scores)
    shifted = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _summed(values: Column, n: int) -> Column:
    """Sums of arrays, place by place."""
    return F.array(*(F.sum(values[k]) for k in range(n)))


def _shares(sums: Column, count: Column, own: Column, own_count: Column, above: Column) -> Column:
    """Shares in ``sums`` over ``count`` records without a record's ``own`` part, pulled towards ``above``."""
    rest = F.zip_with(sums, own, lambda s, o: F.greatest(s - o, F.lit(0.0)))
    return F.zip_with(rest, above, lambda r, a: (r + PULL * a) / (count - own_count + PULL))


def identify(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per document and page: kind, doc_id or page_id, lang, probability and the evidence.

    ``docs``: doc_id, text, lang, source (as host). ``pages``: page_id, url, html.
    """
    spark = docs.sparkSession
    model = train(docs)
    n = len(model.languages)
    shared = spark.sparkContext.broadcast(model)
    fields = "id long, host string, domain string, suffix string, declared string, scores array<double>"
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body"),
                         F.col("source").cast("string").alias("address"), F.col("lang").cast("string").alias("declared"))
    records = map_arrow(source, _records(shared, False), fields).withColumn("kind", F.lit("document"))
    if pages is not None:
        source = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").cast("string").alias("body"),
                              F.col("url").cast("string").alias("address"))
        records = records.unionByName(
            map_arrow(source, _records(shared, True), fields).withColumn("kind", F.lit("page")))
    ident = [F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
             F.when(F.col("kind") == "page", F.col("id")).alias("page_id")]
    if not n:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")]
        return records.select("kind", *ident, "host", "suffix", "declared", *nothing,
                              F.lit(0.0).alias("probability"))
    records = written(records, "langid-records")

    names, p = F.array(*map(F.lit, model.languages)), F.col("p")
    place = F.coalesce(F.array_position(names, F.col("declared")).cast("int"), F.lit(0))  # from 1; 0: says nothing
    records = records.select("*", _posteriors(F.col("scores")).alias("p"), place.alias("place"))
    hot = F.transform(names, lambda x: (x == F.col("declared")).cast("double"))  # 1 for the declared language
    records = records.withColumn("said", F.when(F.col("place") > 0, hot))

    text = F.array_max("scores") != 0  # some text evidence
    agreed = F.when(text & (F.col("place") > 0), p[F.col("place") - 1])
    overall = records.agg(_summed(p, n), F.count("*"), F.sum(agreed), F.count(agreed)).first()
    world = [((x or 0.0) + 1.0) / (overall[1] + n) for x in overall[0]]
    agreement = ((overall[2] or 0.0) + 1.0) / (overall[3] + 2.0)

    def sums(by: str, *keys: str) -> DataFrame:
        """Per key, the summed posteriors and declarations of its records."""
        return written(records.filter(F.col(by).isNotNull()).groupBy(*keys, by).agg(
            _summed(p, n).alias(f"{by}_p"), F.count("*").alias(f"{by}_n"),
            _summed(F.coalesce("said", F.array_repeat(F.lit(0.0), n)), n).alias(f"{by}_said"),
            F.count("said").alias(f"{by}_said_n")), f"langid-{by}")

    joined = records
    for by, keys in (("host", ["kind"]), ("domain", ["kind"]), ("suffix", []), ("declared", [])):
        joined = joined.join(sums(by, *keys), [*keys, by], "left")

    everywhere = F.array(*map(F.lit, world))

    def at_key(by: str, above: Column) -> Column:
        """Shares of the languages at a level; those above where the record has no key there."""
        return F.when(F.col(by).isNotNull(), _shares(F.col(f"{by}_p"), F.col(f"{by}_n"), p, F.lit(1), above)).otherwise(above)

    # A declared language has the learned agreement rate, the others share the rest as everywhere.
    def declared_prior(w: Column, i: Column) -> Column:
        left = F.lit(1.0) - everywhere[F.col("place") - 1]
        return F.when(i + 1 == F.col("place"), agreement).otherwise((1 - agreement) * w / left)

    prior = F.when((F.col("place") > 0) & F.lit(n > 1), F.transform(everywhere, declared_prior)).otherwise(everywhere)
    said = F.coalesce("said", F.array_repeat(F.lit(0.0), n))
    suffix_said = F.when(F.col("suffix").isNotNull(), _shares(
        F.col("suffix_said"), F.col("suffix_said_n"), said, F.col("said").isNotNull().cast("int"), everywhere)
        ).otherwise(everywhere)

    def likelihood(shares: Column) -> Column:
        """log P(evidence | language) up to a constant."""
        return F.zip_with(shares, everywhere, lambda x, w: F.log(x / w))

    terms = joined.select(
        "kind", *ident, "host", "suffix", "declared", "scores",
        F.transform(at_key("host", at_key("domain", everywhere)), lambda x: F.log(x)).alias("host_log"),
        likelihood(at_key("suffix", suffix_said)).alias("suffix_log"),
        F.when(F.col("place") > 0, likelihood(at_key("declared", prior)))
        .otherwise(F.array_repeat(F.lit(0.0), n)).alias("declared_log"))
    total = F.col("scores")
    for more in ("host_log", "suffix_log", "declared_log"):
        total = F.zip_with(total, F.col(more), lambda x, y: x + y)
    fused = terms.withColumn("fused", _posteriors(total))
    best = lambda c: names[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    return fused.select("kind", "doc_id", "page_id", "host", "suffix", "declared", best(F.col("scores")).alias("text_lang"),
                        best(F.col("fused")).alias("lang"), F.array_max("fused").alias("probability"))
