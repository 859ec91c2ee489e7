"""What keeps disk and time of ingests and saved edits in proportion to the rows."""

import contextlib
import datetime as dt
import gzip
import os
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from trendlens import operators as ops
from trendlens.api import TrendingData
from trendlens.plans import standins as st
from trendlens.plans import tables
from trendlens.sources import ingest_csv, read_csv, replace_table, write_csv
from trendlens.sources.edit import in_layout
from trendlens.streaming import replace_batch
from trendlens.streaming.snapshots import dealt


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@contextlib.contextmanager
def seen_layouts():
    """(cluster_by, sort_by) of every layout asked for."""
    seen, deal = [], tables.layout

    def layout(df, cluster_by=(), sort_by=()):
        seen.append((cluster_by, sort_by))
        return deal(df, cluster_by, sort_by)
    tables.layout = layout
    try:
        yield seen
    finally:
        tables.layout = deal


# F1 ------------------------------------------------------------------------

def test_a_batch_is_computed_once(spark, tmp_dir):
    """Laying rows out reads them twice; the text of a batch is parsed and cleaned once."""
    log = os.path.join(tmp_dir, "log")

    def logged(batches):
        with open(log, "a") as f:
            f.write("x\n")
        yield from batches

    rows = spark.createDataFrame([(f"v{i}", dt.date(2024, 1, 1 + i % 9)) for i in range(300)],
                                 "video_id string, video_trending_date date").coalesce(1)
    replace_batch(rows.mapInArrow(logged, rows.schema), 0, os.path.join(tmp_dir, "out"))
    with open(log) as f:
        assert f.read() == "x\n"
    assert rows_of(spark.read.parquet(os.path.join(tmp_dir, "out"))) == rows_of(rows)
    assert not [f for f in os.listdir(os.path.join(tmp_dir, "out")) if f.startswith("_rows")]


def test_rows_of_few_tasks_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(cores + 1)
    assert dealt(few).rdd.getNumPartitions() == cores and dealt(many).rdd.getNumPartitions() == cores + 1
    assert rows_of(dealt(few)) == rows_of(few)


# F2, F4 --------------------------------------------------------------------

def test_the_export_is_compressed_and_has_the_rows_of_the_raw_table(spark, monkeypatch):
    monkeypatch.setattr(tables, "_MEMO", {})
    monkeypatch.setattr(tables, "LINES_A_FILE", 1000)
    path = tables.csv_export(spark, SF001).removeprefix("file:")
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert not any(name == "raw_trending" for *_, name in tables._MEMO)  # no stored copy beside it
    lines = 0
    for f in files:
        with gzip.open(os.path.join(path, f), "rt", encoding="utf-8") as text:
            lines += (n := sum(1 for _ in text)) - 1
            assert n <= 1001
    raw = st.raw_trending(spark, SF001)
    assert lines == raw.count()
    empty_is_null = raw.select(*(F.nullif(c, F.lit("")).alias(c) for c in raw.columns))
    assert rows_of(read_csv(spark, path)) == rows_of(empty_is_null)


def test_compressed_files_are_parsed_whole(spark, tmp_dir):
    rows = [("1", "a\nb", 'say "so"'), ("2", "x,y", None), ("3", " é ", "end")]
    path = write_csv(spark.createDataFrame(rows, "id string, a string, b string").repartition(2), tmp_dir + "/z", compression="gzip")
    back = read_csv(spark, path)
    assert rows_of(back) == rows_of(spark.createDataFrame(rows, "id string, a string, b string"))
    assert "MapInArrow" not in back._jdf.queryExecution().executedPlan().toString()
    assert read_csv(spark, path, infer=True).schema["id"].dataType.simpleString() == "bigint"


# F3 ------------------------------------------------------------------------

def test_an_ingest_of_many_tasks_shuffles_nothing(spark, tmp_dir):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(cores * 20).select(F.col("id").cast("string").alias("id"), F.lit("x, y").alias("t"))
    many = write_csv(rows.repartition(cores * 2), tmp_dir + "/many")
    one = write_csv(rows.coalesce(1), tmp_dir + "/one")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        for path, want in ((many, None), (one, ())):
            with seen_layouts() as seen:
                table = ingest_csv(spark, path, f"ingested_{uuid.uuid4().hex}", location=tmp_dir + "/tables")
            assert [cluster for cluster, _ in seen if cluster != ("csv-heads",)][-1] == want
            assert rows_of(table) == rows_of(rows)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_a_written_table_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum(b.isShuffle() for b in iterable(manager.getAllBlocks()))
    before = shuffles()
    tables.write_table(spark, spark.range(1000).repartition(3, "id"), "dropped")
    assert shuffles() <= before


def iterable(seq):
    return [seq.apply(i) for i in range(seq.size())]


# F5 ------------------------------------------------------------------------

def saved(spark, files=6):
    rows = [(f"v{i % 40:02}", f"t{i}", "A", ("B", "C", None)[i % 3], None if i == 5 else dt.date(2024, 1, 1 + i % 30), i) for i in range(600)]
    name = f"placed_{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, "video_id string, video_title string, channel_country string, video_trending_country string, "
                                     "video_trending_date date, video_view_count bigint")
    (df.repartitionByRange(files, "video_trending_date", "video_id").sortWithinPartitions("video_trending_date", "video_id")
     .write.saveAsTable(name))
    return name


def days_of_files(spark, name):
    found = [pq.read_table(f.removeprefix("file://").removeprefix("file:")).column("video_trending_date").to_pylist()
             for f in spark.table(name).inputFiles()]
    return [[d or dt.date.min for d in days] for days in found]


@pytest.mark.parametrize("edit", ["delete", "update"])
def test_an_edit_of_most_files_keeps_rows_in_their_places(spark, edit):
    name = saved(spark)
    data, where = TrendingData(spark, name), "video_trending_country = 'B'"
    want = rows_of(ops.delete_rows(spark.table(name), where) if edit == "delete"
                   else ops.update_rows(spark.table(name), {"video_title": "new"}, where))
    old = set(spark.table(name).inputFiles())
    with seen_layouts() as seen:
        assert (data.delete(where) if edit == "delete" else data.update({"video_title": "new"}, where)) == 200
    assert seen == [(None, ())]  # nothing is dealt anew
    assert rows_of(spark.table(name)) == want and not old & set(spark.table(name).inputFiles())
    days = days_of_files(spark, name)
    assert len(days) == len(old) and all(d == sorted(d) for d in days)
    ranges = sorted((d[0], d[-1]) for d in days)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:])) and in_layout(spark.table(name), "video_trending_date")


def test_an_edit_lays_out_anew_what_is_out_of_place(spark):
    both = ("video_trending_date", "video_id")
    name = saved(spark)
    with seen_layouts() as seen:  # days change
        TrendingData(spark, name).update({"video_trending_date": dt.date(2024, 1, 9)}, "video_trending_country = 'B'")
    assert seen == [(both, both)]
    name = saved(spark)
    TrendingData(spark, name).insert([{"video_id": "v1", "video_trending_date": d, "video_trending_country": "B"}
                                      for d in ("2024-01-01", "2024-01-30")])
    spark.table(name).coalesce(1).write.mode("overwrite").saveAsTable(name + "_one")
    assert in_layout(spark.table(name + "_one"), "video_trending_date")
    mixed = f"mixed_{uuid.uuid4().hex}"
    spark.table(name).repartition(4, F.col("video_view_count")).write.saveAsTable(mixed)
    assert not in_layout(spark.table(mixed), "video_trending_date")
    want = rows_of(ops.delete_rows(spark.table(mixed), "video_trending_country = 'B'"))
    with seen_layouts() as seen:
        TrendingData(spark, mixed).delete("video_trending_country = 'B'")
    assert seen == [(both, both)] and rows_of(spark.table(mixed)) == want


def test_layout_of_days_that_python_has_not(spark):
    name = f"days_{uuid.uuid4().hex}"
    (spark.sql("select explode(array(date'0000-02-01', date'2024-01-01', date'+12024-01-01', null)) as video_trending_date")
     .repartitionByRange(4, "video_trending_date").write.saveAsTable(name))
    assert in_layout(spark.table(name), "video_trending_date")
    assert in_layout(spark.table(name).select(F.col("video_trending_date").cast("string").alias("d"), "_metadata"), "d")


def test_a_table_written_file_by_file(spark):
    from trendlens.session import file_by_file
    name, copy = saved(spark), f"copy_{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with file_by_file(spark):
        replace_table(spark, spark.table(name), copy, sort_by=None)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert sorted(days_of_files(spark, copy)) == sorted(days_of_files(spark, name))
