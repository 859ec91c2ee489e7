"""Literal tests of the column parsers, each case also run through DuckDB
(the engine whose behaviour the cleaning step was written for)."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from trendlens.functions import (country_key, digits_bigint, duration_seconds, first_nondigit_removed,
                                 french_date, split_tags, to_bigint, to_boolean, to_ts)


def one_col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def duck(expr, values):
    con = duckdb.connect()
    return [con.execute(f"SELECT {expr}", [v]).fetchall()[0][0] for v in values]


NUMBERS = ["12.7", "-0.5", "2.5", "1e3", " 42 ", "1,234", "", "abc", "-12", "+5", "0.49", "9999999999"]


def test_to_bigint_literals(spark):
    got = one_col(spark, NUMBERS, to_bigint)
    assert got == [13, -1, 3, 1000, 42, None, None, None, -12, 5, 0, 9999999999]
    assert got == duck("try_cast(CAST(? AS VARCHAR) AS BIGINT)", NUMBERS)


def test_first_nondigit_removed(spark):
    vals = ["1,234,567", "-5", "123", "", "a1b2", "12.5", "0a.", "1,2.5", " 7"]
    assert one_col(spark, vals, first_nondigit_removed) == ["1234,567", "5", "123", "", "1b2", "125", "0.",
                                                            "12.5", "7"]
    got = one_col(spark, vals, digits_bigint)
    assert got == duck("try_cast(regexp_replace(CAST(? AS VARCHAR), '[^0-9]', '') AS BIGINT)", vals)


def test_digits_fast_path_matches_text_path(spark):
    df = spark.createDataFrame([(v,) for v in [0, 5, -5, 123456789, -(2 ** 63), 2 ** 63 - 1, None]], "x bigint")
    rows = df.select(digits_bigint(F.col("x"), df.schema["x"].dataType).alias("a"),
                     digits_bigint(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [0, 5, 5, 123456789, None, 2 ** 63 - 1, None]


DURATIONS = {
    "PT1H2M3S": 3723, "PT45S": 5, "PT5S": 0, "PT1H45S": 3605, "PT123S": 3, "PT": 0, "PT1M30S": 90, "PT10M": 600,
    "PT2H": 7200, "P1DT2H": None, "none": None, "": None, "PT9223372036854775807H": None,
    "2:30": 9000, "1:02:03": 3723, " 1:02:03 ": 3723, "\t1:02:03": 3723, "1:2:3": 3723, "12:34:56.789": 45296,
    "7:5:9.25": 25509, " 0:00 ": None, "1:02 ": None, "1:02:03\t": 3723, "1:02:03Z": 3723, "1:02:03 Z": 3723,
    "1:02:03+01:30": 3723, "1:02Z": None, "24:00:00": 86400, "24:00:00.000": 86400, "24:00": 86400,
    "24:00:01": None, "24:00:00.5": None, "25:00:00": None, "23:59:60": None, "12:60:00": None,
}


def test_duration_literals(spark):
    got = dict(zip(DURATIONS, one_col(spark, list(DURATIONS), duration_seconds)))
    assert got == DURATIONS


def test_duration_exact_option(spark):
    assert one_col(spark, ["PT45S", "PT5S", "PT1H45S", "PT1M30S"], lambda c: duration_seconds(c, exact=True)) == \
        [45, 5, 3645, 90]


def test_rewritten_forms_are_no_dates_or_clocks(spark):
    assert one_col(spark, ["2024/mai/5", "\x01/2024/mai/5", "/mai/"], french_date) == [None] * 3
    assert one_col(spark, ["\x01:1:02:03:", "\x01:1:2::", ":1:2:3:"], duration_seconds) == [None] * 3


FRENCH = ["Samedi 9 AOÛT 2025", "5 août 2024", "jeudi 3 foo 2024", "Mardi 5 août 2024", "lundi 1 fevrier 2021",
          "Dimanche 31 décembre 2023  ", "Lundi 29 février 2024", "x 12 Mars 1999", "Lundi 31 février 2024"]


def test_french_date_literals(spark):
    got = one_col(spark, FRENCH, french_date)
    assert got == [dt.date(2025, 8, 9), None, None, dt.date(2024, 8, 5), dt.date(2021, 2, 1),
                   dt.date(2023, 12, 31), dt.date(2024, 2, 29), dt.date(1999, 3, 12), None]


TIMESTAMPS = ["5/3/2024 7:05", "2024-03-05T01:02:03Z", " 2024-03-05 ", "2024-03-05 01:02:03", "31/12/2023 23:59",
              "bad", "", "2024-3-5"]


def test_to_ts_literals(spark):
    got = one_col(spark, TIMESTAMPS, to_ts)
    assert got[:3] == [dt.datetime(2024, 3, 5, 7, 5), None, dt.datetime(2024, 3, 5)]
    fmts = ("%d/%m/%Y %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")
    expr = "coalesce(" + ", ".join(f"try_strptime(x, '{f}')" for f in fmts) + ")"
    con = duckdb.connect()
    want = [con.execute(f"SELECT {expr} FROM (SELECT CAST(? AS VARCHAR) AS x)", [v]).fetchall()[0][0]
            for v in TIMESTAMPS]
    assert got == want


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_to_ts_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = one_col(spark, ["2024-03-31 02:30:00", "31/3/2024  2:30", "2024-03-31 \t02:30:00", "5/3/24 7:05",
                              "31/02/2024 1:00", "2024-02-30", "2024-01-01 24:00:00", "1/1/2024"], to_ts)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    half = dt.datetime(2024, 3, 31, 2, 30)
    assert got == [half, half, half, dt.datetime(24, 3, 5, 7, 5), None, None, None, None]


def test_padded_booleans_are_null(spark):
    assert one_col(spark, [" true", "true ", "\tt"], to_boolean) == [None] * 3


def test_to_boolean(spark):
    vals = ["True", "yes", "1", "t", "false", "0", "no", "on", "maybe", ""]
    got = one_col(spark, vals, to_boolean)
    assert got[:4] == [True] * 4 and got[4:7] == [False] * 3 and got[7:] == [None] * 3


def test_split_tags_keeps_empty_parts(spark):
    df = spark.createDataFrame([(" A,b,,C? ",)], "x string")
    assert df.select(split_tags("x")).first()[0] == ["a", "b", "", "c?"]


def test_country_key(spark):
    vals = [" USA ", "Côte d'Ivoire", "Ivory Coast", "RUSSIA", "", None, "Burma", "São Tomé", "\tUK\u00a0",
            "Việt Nam", "Ελλάδα"]
    assert one_col(spark, vals, country_key) == ["united states of america", "cote d'ivoire", "cote d'ivoire",
                                                  "russian federation", "", None, "myanmar", "sao tome",
                                                  "united kingdom", "viet nam", "ελλαδα"]


@pytest.mark.parametrize("text", ["Été", "ÀÉÎÕÜ çñ", "Ångström", "ø æ ß đ", "Việt Nam", "Ελλάδα", "Йемен"])
def test_accent_strip_matches_nfd_rule(spark, text):
    import unicodedata
    from trendlens.functions.text import strip_accents
    want = "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)
    want = unicodedata.normalize("NFC", want)
    assert one_col(spark, [text], strip_accents) == [want]


MORE_NUMBERS = ['0x10', '0X1f', '-0x10', '1_000', '1__0', '_1', '1_', '0b101', '0B11', '1_000.5', '1_0e2', '0x_1', '0x', ' 0x10 ',
           '0x1_0', '1.5_0', '0x8000000000000000', '0x7fffffffffffffff', '0xfffffffffffffffffffff', '0o17', '+0x10', '0x1.5',
           '1_000_000', '1_.5', '12_3e1', ' 1_0 ', '0b', '0b2', '-1_0', '12', ' 7 ', '-3', '2.5', '1e3', '', 'x_1', None]
MOMENTS = ['2024-01-02 03:04:05', '2024-01-02T03:04:05', '2024-01-02 03:04:05.5', '2024-01-02', '2024-01-02 03:04',
           '2024-01-02 03:04:05Z', '2024-01-02 03:04:05+02', '2024-13-02 03:04:05', '2024-01-02 24:00:00', '2024-01-02  03:04:05',
           ' 2024-01-02 03:04:05 ', '2024-1-2 3:04:05', '2024-02-30', '03:04:05-02', '01:02:03', '2024-01-02 x', None]


def test_numbers_with_bases_and_separators(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(MORE_NUMBERS)], "i int, v string")
    got = [r.n for r in rows.select("i", to_bigint("v").alias("n")).orderBy("i").collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT try_cast(? AS BIGINT)", [v]).fetchall()[0][0] for v in MORE_NUMBERS]


def test_clock_of_a_moment(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(MOMENTS)], "i int, v string")
    got = [r.n for r in rows.select("i", duration_seconds("v").alias("n")).orderBy("i").collect()]
    con = duckdb.connect()
    sql = "SELECT CAST(floor(epoch(try_cast(? AS TIME))) AS BIGINT)"
    assert got == [con.execute(sql, [v]).fetchall()[0][0] for v in MOMENTS]
