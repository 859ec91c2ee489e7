"""The endpoint-style facade over a catalog table."""

import datetime as dt

from trendlens.api import TrendingData, fetch

ROWS = [("a", "A", "c1", "France", "Spain", dt.date(2024, 1, 1), 100, 10, 1, "x,yy"),
        ("a", "A", "c1", "France", "Spain", dt.date(2024, 1, 2), 300, 30, 3, "x,yy"),
        ("b", "B", "c2", "Spain", "Spain", dt.date(2024, 1, 1), 7, 5, 0, "yy,zz")]
SCHEMA = ("video_id string, video_title string, channel_title string, channel_country string, "
          "video_trending_country string, video_trending_date date, video_view_count bigint, "
          "video_like_count bigint, video_comment_count bigint, video_tags string")


def test_facade_round_trip(spark):
    spark.createDataFrame(ROWS, SCHEMA).write.mode("overwrite").saveAsTable("trending_clean_api")
    data = TrendingData(spark, "trending_clean_api")
    counts, totals = data.country_counts()
    assert {r.country: r.cnt for r in counts.collect()} == {"Spain": 2}
    assert totals.first().asDict() == {"total": 2, "max_count": 2}
    flows, ftot = data.country_flows(mode="international")
    assert [(r.src, r.dst, r.cnt, r.views) for r in flows.collect()] == [("France", "Spain", 1, 300)]
    got = fetch(data.dates(), 1)
    assert got.rows == [("2024-01-01",)] and got.truncated
    assert [r.tag for r in data.tags(mode="all", on_date="2024-01-01").collect()] == ["yy"]
    assert data.update({"video_title": "New"}, "video_id = 'b'") == 1
    assert data.delete("video_id = 'a' AND video_trending_date = DATE'2024-01-01'") == 1
    assert data.insert([{"video_id": "c", "video_trending_date": "2024-01-03"}]) == 1
    final = {(r.video_id, r.video_title) for r in spark.table("trending_clean_api").collect()}
    assert final == {("a", "A"), ("b", "New"), ("c", None)}
    res = data.query("select video_id from trending_clean_api order by video_id", max_rows=2)
    assert res.rows == [("a",), ("b",)] and res.truncated


def test_facade_inserts_a_frame_and_falls_back(spark):
    import pytest
    table = spark.createDataFrame(ROWS, SCHEMA)
    table.write.mode("overwrite").saveAsTable("trending_api_insert")
    data = TrendingData(spark, "trending_api_insert")
    files = set(spark.table("trending_api_insert").inputFiles())
    assert data.insert(spark.sql("select 'z' as video_id")) == 1
    assert files < set(spark.table("trending_api_insert").inputFiles())  # appended, nothing rewritten
    assert data.update({"video_title": "x"}, "video_id = 'nobody'") == 0
    assert data.clean.count() == 4 and data.videos(limit=None, mode="all").count() == 3
    missing = TrendingData(spark, "no_such_table", raw=table)
    assert missing.country_counts()[0].count() == 1 and missing.country_flows()[0].count() == 2
    with pytest.raises(ValueError):
        missing.country_flows(mode="international")
