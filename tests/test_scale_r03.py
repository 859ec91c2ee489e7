"""What keeps time, memory and shuffle in proportion to the rows."""

import datetime as dt
import os
import re

from pyspark.sql import functions as F

from tests.conftest import SF001
from trendlens import operators as ops
from trendlens.operators import bitmaps
from trendlens.plans import bucketed, tables
from trendlens.plans.cleaning import RAW_COLUMNS, clean_trending
from trendlens.sources.infer import cell_types, column_masks


def largest_method(df, capsys) -> int:
    """Bytes of the largest method Spark generates for the plan; the JVM compiles none beyond 8000."""
    capsys.readouterr()
    df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)), default=0)


def test_cleaning_generates_methods_that_the_jvm_compiles(spark, tmp_dir, capsys):
    spark.createDataFrame([["1"] * len(RAW_COLUMNS)], ", ".join(f"{c} string" for c in RAW_COLUMNS)).write.parquet(tmp_dir + "/raw")
    assert largest_method(clean_trending(spark.read.parquet(tmp_dir + "/raw")), capsys) < 8000


def test_cell_types_of_one_lambda(spark, capsys):
    rows = [("1", "1.5", "2024-01-02", "2024-01-02", "true", "12:00", None), (" 2 ", "3", "2024-1-3", "2024-01-02 10:00", "FALSE", "x", None),
            (None, "99999999999999999999", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i string, d string, day string, ts string, b string, t string, n string")
    assert cell_types(df) == {"i": "bigint", "d": "double", "day": "date", "ts": "timestamp", "b": "boolean", "t": "string", "n": "string"}
    wide = spark.createDataFrame([["1"] * 24], ", ".join(f"c{i} string" for i in range(24)))
    assert largest_method(column_masks(wide, wide.columns), capsys) < 8000


def test_layout_none_deals_no_rows(spark):
    assert "Exchange" not in tables.layout(spark.range(9), None)._jdf.queryExecution().executedPlan().toString()


def test_quoted_export_has_more_files_for_more_lines(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES_A_FILE", 1000)
    monkeypatch.setattr(tables, "_MEMO", {})
    path = tables.quoted_export(spark, SF001)
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]) > 4


def test_bitmaps_are_united_in_bounded_tasks(spark, monkeypatch):
    rows = [(f"v{i % 400}", None if i % 31 == 0 else f"c{i % 5}", dt.date(2024, 1, 1 + i % 9)) for i in range(3000)]
    rows += [(None, "only_null", dt.date(2024, 1, 1)), (None, "c1", None)]
    df = spark.createDataFrame(rows, "video_id string, video_trending_country string, video_trending_date date")
    numbers = bitmaps.numbered(tables.write_table(spark, bitmaps.video_numbers(df), "numbers"))
    # Far numbers: more buckets than a task holds at a time.
    numbers = numbers.withColumn("number", F.col("number") * 20_000)
    stored = tables.write_table(spark, bitmaps.day_bitmaps(df, numbers), "bits").coalesce(1)
    monkeypatch.setattr(bitmaps, "MOST_OPEN", 3)
    got = sorted(map(tuple, bitmaps.counts_from_bitmaps(stored).collect()), key=str)
    assert got == sorted(map(tuple, ops.country_counts(df).collect()), key=str)
    assert "MapInArrow" in bitmaps.counts_from_bitmaps(stored)._jdf.queryExecution().executedPlan().toString()


def test_more_buckets_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 10)
    assert bucketed.enough_buckets(spark.range(35), 2) == 4
    assert bucketed.enough_buckets(spark.range(5), 2) == 2


def test_clean_table_shuffles_no_derived_texts(spark):
    """The layout deals the rows of the join; tags, titles and keys are made of them in their places."""
    from trendlens.plans import standins as st
    facts = st.trending_facts(spark, SF001)
    assert not {"video_tags", "video_title", "video_key", "channel_key", "l_extendedprice"} & set(facts.columns)
    laid = st.trending_columns(tables.layout(facts, (tables.DAY,), (tables.DAY, "video_id")))
    tree = laid._jdf.queryExecution().executedPlan().toString()
    assert tree.index("why?") < tree.index("rangepartitioning")  # made above the shuffle
    want = st.trending(spark, SF001)
    assert laid.schema == want.schema and laid.exceptAll(want).isEmpty() and want.exceptAll(laid).isEmpty()
    stored = tables.trending_table(spark, SF001).select(*want.columns)
    assert stored.exceptAll(want).isEmpty() and want.exceptAll(stored).isEmpty()


def test_tags_are_exploded_in_their_places(spark, tmp_dir):
    from trendlens.sources import save_table
    rows = spark.createDataFrame([("v1", dt.date(2024, 1, 2), "a1, b2,b2"), ("v2", dt.date(2024, 1, 1), "b2,x"), ("v3", None, None),
                                  (None, dt.date(2024, 1, 1), "c3")], "video_id string, video_trending_date date, video_tags string")
    want = ops.explode_tags(rows)
    shuffled = []
    deal = tables.layout
    def seen(df, *args):
        shuffled.append(df.columns)
        return deal(df, *args)
    tables.layout = seen
    try:
        path = save_table(rows, tmp_dir + "/tags", (tables.DAY,), (tables.DAY, "video_id"), finish=ops.explode_tags)
    finally:
        tables.layout = deal
    got = spark.read.parquet(path)
    assert shuffled == [rows.columns]
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
