"""Small tables with the awkward rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, `sha256 x` int"
WORDS = "the of and in to la le der die el los tion ing ment keit".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def awkward_rows(seed=1):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, near copies, clashing columns."""
    rng = random.Random(seed)
    long_text = prose(rng, 30_000)
    base = prose(rng, 120)
    near = base.replace(" ", " x", 1)
    texts = [None, "", " \t\n ", "One.", "a b c d", "a b c d", "A B C D", "a b c d e", base, base, near, base + " end",
             long_text, long_text, prose(rng, 60) + "\n" + prose(rng, 10), "x" * 5000, "# * $ %\n" * 60, "é ü ñ 日本 🙂",
             "same line\n" * 40, base.upper()]
    rows = [(i, t, rng.choice(["en", "fr", None, "??"]), "src0", None if t is None else len(t), "k", None, i)
            for i, t in enumerate(texts)]
    rows += [rows[8], rows[8]]                                        # a row repeated
    rows += [(None, "no id", None, None, None, None, None, None), (None, None, "en", None, 0, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
