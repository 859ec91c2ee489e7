"""Saved edits: only files with hits are rewritten, the tag table follows, no moment loses a table."""

import collections
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from trendlens import operators as ops
from trendlens.api import TrendingData
from trendlens.sources import open_table, replace_table, rewrite, vacuum_table
from trendlens.sources import edit as edits

SCHEMA = "video_id string, video_title string, channel_country string, video_trending_country string, " \
         "video_trending_date date, video_view_count bigint, video_tags string"


def make(spark, files=6, partitioned=False):
    """A saved table with one file (or partition) per week, and its tag table."""
    rng = random.Random(7)
    rows = [(f"v{rng.randrange(40)}", f"t{i}", "A", rng.choice(["B", "C", None]),
             dt.date(2024, 1, 1) + dt.timedelta(days=i % (7 * files)), i,
             rng.choice([None, "", "red,Blue", "red, red,green", "x,why?", " blue ,red"])) for i in range(600)]
    name, folder = f"edited_{uuid.uuid4().hex}", None
    df = spark.createDataFrame(rows, SCHEMA).withColumn("week", F.expr("cast(datediff(video_trending_date, DATE'2024-01-01') / 7 as int)"))
    writer = df.repartitionById(files, "week").sortWithinPartitions("video_trending_date", "video_id").write
    (writer.partitionBy("week") if partitioned else writer).saveAsTable(name)
    tags = f"tags_{name}"
    (ops.explode_tags(spark.table(name)).repartitionByRange(files, "video_trending_date")
     .sortWithinPartitions("video_trending_date", "video_id").write.saveAsTable(tags))
    return name, tags


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def files_of(spark, name):
    return set(spark.table(name).inputFiles())


def rebuilt(spark, clean):
    return rows_of(ops.explode_tags(spark.table(clean)))


@pytest.mark.parametrize("partitioned", [False, True])
def test_only_files_with_hits_are_rewritten(spark, partitioned):
    name, _ = make(spark, partitioned=partitioned)
    data, before = TrendingData(spark, name), files_of(spark, name)
    columns = spark.table(name).columns
    want = ops.update_rows(spark.table(name), {"video_title": "new"}, "video_trending_date = DATE'2024-01-03'")
    want = rows_of(want)
    assert data.update({"video_title": "new"}, "video_trending_date = DATE'2024-01-03'") == 15
    after = files_of(spark, name)
    assert len(before) == 6 and len(before - after) == len(after - before) == 1
    assert rows_of(spark.table(name)) == want and spark.table(name).columns == columns
    one_video = spark.table(name).groupBy("video_id").agg(F.countDistinct("week").alias("weeks")).where("weeks < 3").first()
    assert one_video is None or data.delete(f"video_id = '{one_video.video_id}'") > 0
    assert data.update({"video_title": "new"}, "video_id = 'nobody'") == 0
    assert vacuum_table(spark, name) >= 1 and vacuum_table(spark, name) == 0


def test_an_edit_of_most_files_writes_the_table_anew(spark):
    name, _ = make(spark)
    before = files_of(spark, name)
    assert TrendingData(spark, name).delete("video_trending_country = 'B'") > 100
    assert not before & files_of(spark, name) and spark.table(name).where("video_trending_country = 'B'").isEmpty()


def test_tags_follow_edits(spark):
    name, tags = make(spark)
    data = TrendingData(spark, name, tags)
    before = files_of(spark, tags)
    data.update({"video_tags": "Green,red,?,  new one "}, "video_trending_date = DATE'2024-01-03'")
    assert rows_of(spark.table(tags)) == rebuilt(spark, name)
    assert len(before - files_of(spark, tags)) == 1  # and only the file with that day
    data.update({"video_title": "x"}, "video_trending_date = DATE'2024-01-10'")
    data.insert([{"video_id": "v1", "video_trending_date": "2024-01-03", "video_tags": "red,red,blue"},
                 {"video_id": None, "video_tags": "red"}])
    assert rows_of(spark.table(tags)) == rebuilt(spark, name)
    data.update({"video_trending_date": dt.date(2024, 2, 1)}, "video_id = 'v3'")
    assert rows_of(spark.table(tags)) == rebuilt(spark, name)
    assert data.delete("video_id = 'v1' OR video_id IS NULL") > 0
    assert rows_of(spark.table(tags)) == rebuilt(spark, name)
    top = lambda t: [tuple(r) for r in ops.top_tags(t, spark.table(name), mode="all", min_count=1).collect()]
    assert top(spark.table(tags)) == top(None)



def test_repeated_rows_in_pieces(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 23), ("d", 5), (None, 2)], "tag string, n bigint")
    from trendlens.operators.tags import repeated
    got = collections.Counter(r.tag for r in repeated(rows, "n", most=5).collect())
    assert got == {"b": 1, "c": 23, "d": 5, None: 2}


@pytest.mark.parametrize("stop", ["before_marker", "first_move", "later_move", "cleaning"])
def test_a_failed_edit_leaves_the_old_table_or_is_finished(spark, monkeypatch, stop):
    name, _ = make(spark)
    old = rows_of(spark.table(name))
    where = "video_trending_date IN (DATE'2024-01-03', DATE'2024-01-12')"
    new = rows_of(ops.delete_rows(spark.table(name), where))
    real_move, real_write, real_delete, moves = rewrite.Files.move, rewrite.Files.write, rewrite.Files.delete, []

    def fail(*_):
        raise OSError("injected")

    def move(self, source, target):
        if not source.startswith("_writing"):
            moves.append(source)
            if len(moves) == {"first_move": 1, "later_move": 3}.get(stop):
                fail()
        real_move(self, source, target)

    monkeypatch.setattr(rewrite.Files, "move", move)
    if stop == "before_marker":
        monkeypatch.setattr(rewrite.Files, "write", fail)
    if stop == "cleaning":
        monkeypatch.setattr(rewrite.Files, "delete", fail)
    with pytest.raises(OSError, match="injected"):
        TrendingData(spark, name).delete(where)
    monkeypatch.setattr(rewrite.Files, "move", real_move)
    monkeypatch.setattr(rewrite.Files, "write", real_write)
    monkeypatch.setattr(rewrite.Files, "delete", real_delete)
    spark.catalog.refreshTable(name)
    assert rows_of(open_table(spark, name)) == (old if stop == "before_marker" else new)
    assert not rewrite.recover(spark, name)


@pytest.mark.parametrize("stop", ["CREATE", "RENAME 1", "RENAME 2", "DROP"])
def test_a_failed_switch_leaves_a_table(spark, monkeypatch, stop):
    name = f"switched_{uuid.uuid4().hex}"
    replace_table(spark, spark.range(3).toDF("a"), name)
    new = spark.createDataFrame([(1, "x")], "b int, c string")
    real, renames = type(spark).sql, []

    def sql(self, text, *args, **kwargs):
        if " RENAME TO " in text:
            renames.append(text)
        word = f"RENAME {len(renames)}" if " RENAME TO " in text else text.split()[0]
        if word == stop:
            raise RuntimeError("injected")
        return real(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", sql)
    with pytest.raises(RuntimeError, match="injected"):
        replace_table(spark, new, name)
    monkeypatch.setattr(type(spark), "sql", real)
    got = open_table(spark, name)
    assert got.columns == (["a"] if stop in ("CREATE", "RENAME 1") else ["b", "c"])
    assert got.count() == (3 if got.columns == ["a"] else 1)
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith(name)]
    assert left == [name]
    assert replace_table(spark, new, name).columns == ["b", "c"]


def test_files_elsewhere_are_not_rewritten(spark):
    assert rewrite._relative(["file:/a/b/x.parquet", "file:///a/b/y=1/z"], "file:/a/b") == ["x.parquet", "y=1/z"]
    assert rewrite._relative(["/a/b/x"], "file:/a/b/") == ["x"] and rewrite._relative(["/a/c/x"], "/a/b") is None
    assert rewrite._relative(["hdfs://n:8020/t/x"], "hdfs://n:8020/t") == ["x"]


def test_tags_without_hits_in_the_tag_table(spark):
    name, tags = make(spark)
    before = files_of(spark, tags)
    changes = spark.createDataFrame([("nothing", "v0", dt.date(2024, 1, 1), -1)], "tag string, video_id string, "
                                    "video_trending_date date, n long")
    edits.follow_tags(spark, tags, changes)
    assert before <= files_of(spark, tags)
