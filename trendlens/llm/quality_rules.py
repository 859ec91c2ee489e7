"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

A rule rejects a text by one condition on a metric of the text. Each rule is
timed on a sample of the documents, which also gives its rejection rate; the
cascade then tests the rules in falling order of rejection rate per second, in
one CASE whose later branches are not evaluated once a rule has rejected. The
verdict is the same in any order: the sample decides the work, never the rows.

Everything is built-in Spark SQL; each text is judged in its own row, so there
is no shuffle and nothing a frequent source or text could skew.

Nulls count as empty texts (no words: rejected as too short). Ties in the
order are broken by the rule's place in the list.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
REPEATS = 3             # measured runs of a rule
LEAST_SECONDS = 1e-4    # a rule is taken to need at least this

Metrics = Callable[[str], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once (inside lambdas it would be computed per element)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD_CHAR))


def count_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    removed = text
    for symbol in SYMBOLS:
        removed = F.replace(removed, F.lit(symbol), F.lit(""))
    return (F.octet_length(text) - F.octet_length(removed)).cast("long")


def _repeated(windows: Column) -> Column:
    """Words covered by the windows (hash, three words, place) that occur more than once."""
    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(s: Column) -> Column:
        n = F.size(s) - 1
        pairs = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n),
                           lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))

    def covered(p: Column) -> Column:
        shifted = F.flatten(F.array(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))
        return F.size(F.array_distinct(shifted))

    return _let(F.sort_array(windows), lambda s: _let(places(s), covered))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds at least twice.

    Sorting the windows (by hash, then by their words, so that equal hashes
    of different windows do no harm) puts equal ones side by side. Texts whose
    window hashes all differ skip the sort.
    """
    def of(w: Column) -> Column:
        n = F.size(w) - 2
        zipped = F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"))
        hashed = lambda x: F.xxhash64(x["a"], x["b"], x["c"])
        # One flat struct: a nested one is compared far more slowly.
        keyed = lambda x, i: F.struct(hashed(x).alias("h"), x["a"], x["b"], x["c"], i.alias("i"))
        some = lambda z: F.when(F.size(F.array_distinct(F.transform(z, hashed))) < F.size(z),
                                _repeated(F.transform(z, keyed))).otherwise(F.lit(0))
        return F.when(n >= 2, _let(zipped, some)).otherwise(F.lit(0))

    return _let(words, of).cast("long")


def metric_of_text(text: Column) -> Metrics:
    """The metrics as expressions on the text, for a cascade over raw texts."""
    def metric(name: str) -> Column:
        if name == "n_words":
            return F.size(words_of(text)).cast("long")
        if name == "word_chars":
            return F.char_length(F.array_join(words_of(text), "")).cast("long")
        if name == "n_symbols":
            return count_symbols(text)
        if name == "n_lines":
            return F.size(lines_of(text)).cast("long")
        if name == "n_dup_lines":
            return _let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        if name == "n_repeat_words":
            return repeated_words(words_of(text))
        raise KeyError(name)
    return metric


METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``condition(metric)`` holds; ``metric(name)`` gives a metric's column."""
    name: str
    condition: Callable[[Metrics], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
# Beyond the base: junk symbols, mostly repeated lines, words of absurd length.
MORE_RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("long_words", lambda m: m("word_chars") > 100 * m("n_words")),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Measured:
    rule: Rule
    rejected: float   # share of the sample
    seconds: float    # of one pass over the sample, scheduling taken off

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def measure_rules(docs: DataFrame, metrics: Metrics, rules: tuple[Rule, ...] = RULES,
                  sample_rows: int = SAMPLE_ROWS, seed: int = 10) -> list[Measured]:
    """Rejection rate and time of each rule on a sample of about ``sample_rows`` rows, best gain first.

    A rule is run once unmeasured, so that it is compiled, and then REPEATS times; its least time counts, less that of
    the same job without a rule, so that scheduling does not. One number per rule reaches the driver.
    """
    total = docs.count()
    sample = docs.sample(False, min(1.0, sample_rows / max(total, 1)), seed).checkpoint()

    def timed(condition: Column) -> tuple[int, float]:
        query = sample.agg(F.count_if(F.coalesce(condition, F.lit(False))))
        hits, least = query.first()[0], float("inf")
        for _ in range(REPEATS):
            began = time.perf_counter()
            query.first()
            least = min(least, time.perf_counter() - began)
        return hits, least

    size, idle = timed(F.col(sample.columns[-1]).isNull() | F.col(sample.columns[-1]).isNotNull())
    out = []
    for rule in rules:
        hits, seconds = timed(rule.condition(metrics))
        out.append(Measured(rule, hits / max(size, 1), max(seconds - idle, LEAST_SECONDS)))
    return sorted(out, key=lambda m: -m.gain)


def first_rejection(rules: list[Rule], metrics: Metrics) -> Column:
    """Name of the first rule in the given order that rejects, else null; later rules are not evaluated."""
    name = None
    for rule in rules:
        test = F.coalesce(rule.condition(metrics), F.lit(False))
        name = F.when(test, rule.name) if name is None else name.when(test, rule.name)
    return F.lit(None).cast("string") if name is None else name


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, all columns as they are; only the metrics a text's verdict needs are computed."""
    metrics = metric_of_text(docs[text])
    order = [m.rule for m in measure_rules(docs.select(text), metric_of_text(F.col(text)), rules, sample_rows)]
    return docs.filter(first_rejection(order, metrics).isNull())


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document with every metric, the base verdict and the cascade's verdict."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    parts = plain.select("doc_id", "text", words_of(F.col("text")).alias("words"), lines_of(F.col("text")).alias("lines"))
    report = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_symbols(F.col("text")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"))
    # The order is measured on raw texts, where a rule's cost is that of its metric.
    order = [m.rule for m in measure_rules(plain, metric_of_text(F.col("text")), RULES, sample_rows)]
    base = first_rejection(list(BASE_RULES), F.col)
    contract = [c for c in report.columns if c != "n_lines"]
    return report.select(*contract, base.isNotNull().alias("base_failed"),
                         first_rejection(order, F.col).isNull().alias("kept"), "n_lines")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
pos AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d),
win AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM pos),
rep AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM win) WHERE times > 1)
  GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM ln
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > n_lines OR word_chars > 100 * n_words) AS kept
FROM m
"""
