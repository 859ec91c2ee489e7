"""Property tests of the column parsers on generated text: against DuckDB, or
against what the generator knows it has written.

Each example is a batch of strings evaluated in one job, so a few examples
cover thousands of inputs.
"""

import datetime as dt

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendlens.functions import digits_bigint, duration_seconds, french_date, to_bigint, to_ts

SETTINGS = settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))

digits = st.text("0123456789", min_size=0, max_size=4)
number_text = st.builds(lambda sign, a, dot, b, exp, pad: f"{pad}{sign}{a}{dot}{b}{exp}{pad}",
                        st.sampled_from(["", "-", "+"]), digits, st.sampled_from(["", "."]), digits,
                        st.sampled_from(["", "e2", "E1", "e-1"]), st.sampled_from(["", " "]))
def _clock(h, m, s, fraction, pad):
    """A clock text and its seconds: h:m or h:m:s[.fraction], blanks only with seconds."""
    text = f"{h}:{m:02d}" + ("" if s is None else f":{s:02d}{fraction}")
    late = h == 24 and (m or s or fraction.strip(".0"))
    bad = h > 24 or m > 59 or (s or 0) > 59 or late
    return (f"{pad}{text}{pad}" if s is not None else text, None if bad else h * 3600 + m * 60 + (s or 0))


def _iso(h, m, s):
    """An ISO text and its seconds as the cleaning step reads them: of the seconds only the digits behind
    another number count (the minutes, or the leading digits of the seconds themselves)."""
    text = "PT" + f"{h}H" * (h is not None) + f"{m}M" * (m is not None) + f"{s}S" * (s is not None)
    seconds = 0 if s is None else s if m is not None else int(str(s)[-1]) if s > 9 else 0
    return text, (h or 0) * 3600 + (m or 0) * 60 + seconds


clock_text = st.builds(_clock, st.integers(0, 26), st.integers(0, 61), st.sampled_from([None, 0, 5, 59, 60]),
                       st.sampled_from(["", ".0", ".5", ".000"]), st.sampled_from(["", " "]))
iso_text = st.builds(_iso, st.sampled_from([None, 1, 12]), st.sampled_from([None, 5, 45]),
                     st.sampled_from([None, 7, 30, 123]))
MONTH_WORDS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "Mai": 5, "juin": 6,
               "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
               "decembre": 12, "foo": None}


def _day(weekday, d, month, y, case):
    try:
        day = dt.date(y, MONTH_WORDS[month] or 0, d)
    except ValueError:
        day = None
    return case(f"{weekday} {d} {month} {y}"), day


day_text = st.builds(_day, st.sampled_from(["Lundi", "mardi", "Été"]), st.integers(0, 32),
                     st.sampled_from(list(MONTH_WORDS)), st.integers(1999, 2025), st.sampled_from([str, str.upper]))
ts_text = st.builds(lambda d, m, y, hh, mm, shape: shape.format(d=d, m=m, y=y, hh=hh, mm=mm),
                    st.integers(0, 32), st.integers(0, 13), st.integers(1990, 2030), st.integers(0, 25),
                    st.integers(0, 61),
                    st.sampled_from(["{d}/{m}/{y} {hh}:{mm}", "{y}-{m}-{d} {hh}:{mm}:{mm}", "{y}-{m}-{d}",
                                     " {y}-{m}-{d} ", "{y}-{m}-{d}T{hh}:{mm}:00", "{d}/{m}/{y}"]))


def against_generator(spark, pairs, spark_fn):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], "i int, x string")
    got = [r[1] for r in df.select("i", spark_fn(F.col("x"))).orderBy("i").collect()]
    bad = [(p, g) for p, g in zip(pairs, got) if p[1] != g]
    assert not bad, bad[:5]


def both(spark, values, spark_fn, duck_expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = [r[1] for r in df.select("i", spark_fn(F.col("x"))).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in con.execute(f"SELECT {duck_expr} FROM t ORDER BY i").fetchall()]
    bad = [(v, g, w) for v, g, w in zip(values, got, want) if g != w]
    assert not bad, bad[:5]


@SETTINGS
@given(st.lists(number_text, min_size=50, max_size=300))
def test_to_bigint_like_duckdb(spark, values):
    both(spark, values, to_bigint, "try_cast(x AS BIGINT)")


@SETTINGS
@given(st.lists(st.one_of(number_text, st.text("0123456789-,. a", max_size=8)), min_size=50, max_size=300))
def test_first_nondigit_like_duckdb(spark, values):
    both(spark, values, digits_bigint,
         "try_cast(regexp_replace(x, '[^0-9]', '') AS BIGINT)")


@SETTINGS
@given(st.lists(st.one_of(clock_text, iso_text), min_size=50, max_size=300))
def test_durations(spark, pairs):
    against_generator(spark, pairs, duration_seconds)


@SETTINGS
@given(st.lists(day_text, min_size=50, max_size=300))
def test_french_dates(spark, pairs):
    against_generator(spark, pairs, french_date)


@SETTINGS
@given(st.lists(ts_text, min_size=50, max_size=300))
def test_to_ts_like_duckdb(spark, values):
    both(spark, values, to_ts, "coalesce(try_strptime(x, '%d/%m/%Y %H:%M'), "
                               "try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%d'))")
