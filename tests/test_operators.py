"""Edge cases of the operators on small hand-made tables, checked against
brute-force Python over the same rows."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from trendlens import operators as ops
from trendlens.operators import filters as flt

SCHEMA = ("video_id string, video_title string, channel_title string, channel_country string, "
          "video_trending_country string, video_trending_date date, video_view_count bigint, "
          "video_like_count bigint, video_comment_count bigint, video_tags string")
D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)
ROWS = [
    ("a", "A", "c1", "France", "Spain", D1, 100, 10, 1, "x,y"),
    ("a", "A", "c1", "France", "Spain", D2, 300, 30, 3, "x,y"),
    ("a", "A", "c1", "France", "Italy", D2, 200, 20, 2, "x,z"),
    ("A", None, "c1", " france ", "FRANCE", D2, 50, None, None, "x"),
    ("b", "B", "c2", "Spain", "Spain", D1, -7, 5, 0, None),
    ("b", "B", "c2", "Spain", None, D3, 70, 5, 0, ""),
    ("c", "C", "c3", " ", "Spain", D3, 10, 1, 1, "q?,w"),
    (None, "N", "c3", "Italy", "Spain", D1, 10, 1, 1, "w"),
    ("d", "D", "c2", "Italy", "Spain", None, 5, 1, 1, "w"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_empty_totals(spark, df):
    empty = df.where(F.lit(False))
    assert ops.country_counts_totals(ops.country_counts(empty)).first().asDict() == {"total": 0, "max_count": 0}
    assert ops.flow_totals(ops.country_flows(empty, mode="all")).first().asDict() == {"total": 0, "total_views": 0}
    assert ops.date_range(empty).first().asDict() == {"min_date": None, "max_date": None}


def test_country_counts_nulls_and_date_wins(df):
    got = {r.country: r.cnt for r in ops.country_counts(df).collect()}
    assert got == {"Spain": 4, "Italy": 1, "FRANCE": 1, None: 1}  # NULL id not counted, NULL country a group
    on = {r.country: r.cnt for r in ops.country_counts(df, on_date="2024-01-02", start="2024-01-03").collect()}
    assert on == {"Spain": 1, "Italy": 1, "FRANCE": 1}
    rng = {r.country: r.cnt for r in ops.country_counts(df, start="2024-01-02").collect()}
    assert rng == {"Spain": 2, "Italy": 1, "FRANCE": 1, None: 1}  # NULL day drops out under a range


def test_bad_day_and_mode_refused(df):
    with pytest.raises(ValueError):
        ops.country_counts(df, on_date="2024-13-45")
    with pytest.raises(ValueError):
        ops.country_counts(df, on_date="01/02/2024")
    with pytest.raises(ValueError):
        ops.country_counts(df, on_date="2024-01-02", start="2024-02-30")
    with pytest.raises(ValueError):
        ops.country_flows(df, mode="sideways")
    with pytest.raises(ValueError):
        ops.top_videos_on(df, on_date=None)


def test_flows_dedupe_views_per_video(df):
    got = {(r.src, r.dst): (r.cnt, r.views) for r in ops.country_flows(df, mode="international").collect()}
    # a on France->Spain twice: counted once with its largest views (300);
    # the blank src and the NULL dst rows are dropped.
    assert got == {("France", "Spain"): (1, 300), ("France", "Italy"): (1, 200), ("Italy", "Spain"): (2, 15)}
    dom = {(r.src, r.dst): (r.cnt, r.views) for r in ops.country_flows(df).collect()}
    assert dom == {(" france ", "FRANCE"): (1, 50), ("Spain", "Spain"): (1, 7)}  # -7 reads as 7


def test_sources_list_skips_blanks(df):
    got = ops.country_flows(df, mode="all", sources=[" FRANCE", "", "  "]).collect()
    assert {(r.src, r.dst) for r in got} == {("France", "Spain"), ("France", "Italy"), (" france ", "FRANCE")}
    assert flt.sources_in(["", " "]) is None
    assert ops.country_flows(df, mode="all", sources=" , ").count() == 5  # no filter: all 5 edges


def test_flows_of_video_sums_all_rows(df):
    got = {(r.src, r.dst): (r.cnt, r.views) for r in ops.flows_of_video(df, " A ", mode="all").collect()}
    assert got == {("France", "Spain"): (2, 400), ("France", "Italy"): (1, 200), (" france ", "FRANCE"): (1, 50)}


def test_top_videos_best_row_and_ties(spark):
    rows = [("v1", "t", 5, 1, "S", "D1"), ("v1", "t", 5, 1, "S", "D0"), ("v2", "u", 5, 9, "S", "D")]
    df = spark.createDataFrame(rows, "video_id string, video_title string, video_view_count bigint, "
                                     "video_like_count bigint, channel_country string, video_trending_country string")
    got = [tuple(r) for r in ops.top_videos(df, mode="all").collect()]
    assert got == [("v1", "t", 5, 1, "S", "D0"), ("v2", "u", 5, 9, "S", "D")]
    assert [r.video_id for r in ops.top_videos(df, mode="all", limit=1).collect()] == ["v1"]


def test_listing_filters_do_not_trim_column(df):
    got = ops.top_videos(df, src="FRANCE", mode="all").collect()
    assert {r.video_id for r in got} == {"a"}  # ' france ' is not 'france'
    by_flow = ops.videos_by_flow(df, "2024-01-02", src="france", dst="italy", mode="all").collect()
    assert [(r.video_id, r.views) for r in by_flow] == [("a", 200)]


def test_views_timeline_engagement(df):
    got = [r.asDict() for r in ops.views_timeline(df, "a", mode="all").collect()]
    assert [g["d"] for g in got] == ["2024-01-01", "2024-01-02"]
    # 2024-01-02: max views 300, likes 30, comments 3 -> 11.0
    assert got[1] == {"d": "2024-01-02", "views": 300, "likes": 30, "comments": 3, "engagement_rate": 11.0}
    every = ops.views_timeline(df, mode="all").where("video_id = 'b'").collect()
    assert sorted((r.d, r.views) for r in every) == [("2024-01-01", 7), ("2024-01-03", 70)]


def test_explode_tags_positions(spark):
    df = spark.createDataFrame([("v", D1, " A,b, cc ,,dd?,ee")], "video_id string, video_trending_date date, "
                                                               "video_tags string")
    got = [(r.tag, r.tag_position) for r in ops.explode_tags(df, with_position=True).collect()]
    assert got == [("cc", 3), ("ee", 6)]


def test_explode_tags_rules(df):
    got = sorted((r.tag, r.video_id) for r in ops.explode_tags(df).collect())
    assert ("q?", "c") not in got and ("w", "c") not in got  # '?' and 1-character tags dropped
    assert all(len(t) > 1 for t, _ in got) or got == []


def test_top_tags_equals_many_to_many_brute_force(spark):
    rows = [("v", D1, "S", "D", "alpha,beta"), ("v", D1, "S", "E", "alpha,beta"), ("v", D1, "S", "S", "alpha"),
            ("w", D1, "S", "D", "alpha"), ("w", D2, "S", "D", "gamma,gamma"), ("z", None, "S", "D", "alpha")]
    df = spark.createDataFrame(rows, "video_id string, video_trending_date date, channel_country string, "
                                     "video_trending_country string, video_tags string")
    tags = ops.explode_tags(df)
    got = {r.tag: r.tag_count for r in ops.top_tags(tags, df, mode="international", min_count=1).collect()}
    trows = [(t, v, d) for (v, d, *_rest, text) in rows for t in [p.strip() for p in text.lower().split(",")]
             if len(t) > 1]
    mrows = [(v, d) for (v, d, s, t, _) in rows if s.lower() != t.lower()]
    want = Counter(t for (t, v, d) in trows for (mv, md) in mrows if v == mv and d == md and d is not None)
    assert got == dict(want)
    assert got["alpha"] == 3 * 2 + 1  # key (v, D1): 3 tag rows x 2 matching rows, plus w
    derived = {r.tag: r.tag_count for r in ops.top_tags(None, df, mode="international", min_count=1).collect()}
    assert derived == got


def test_top_channels(df):
    got = [tuple(r) for r in ops.top_channels(df, limit=2).collect()]
    assert got == [("c1", 4), ("c2", 3)]


def test_edits_follow_sql_null_rules(spark, df):
    upd = ops.update_rows(df, {"video_title": "T", "video_view_count": 0}, "video_trending_country = 'Spain'")
    got = upd.collect()
    assert sum(r.video_title == "T" for r in got) == 6
    assert [r.video_title for r in got if r.video_trending_country is None] == ["B"]  # NULL predicate: kept
    kept = ops.delete_rows(df, "video_trending_country = 'Spain'")
    assert kept.count() == len(ROWS) - 6
    assert ops.rows_affected(df, "video_trending_country = 'Spain'") == 6
    ins = ops.insert_rows(df, [{"video_id": "n", "video_trending_date": "2024-02-01"}])
    new = ins.where("video_id = 'n'").first()
    assert new.video_trending_date == dt.date(2024, 2, 1) and new.video_title is None
    with pytest.raises(ValueError):
        ops.update_rows(df, {"nope": 1}, "true")


def test_bounded_select(spark, df):
    res = ops.bounded_select(spark, "SELECT video_id, video_trending_date FROM t ORDER BY video_view_count DESC",
                             max_rows=3, views={"t": df})
    assert res.truncated and res.row_count == 3 and res.columns == ["video_id", "video_trending_date"]
    assert res.rows[0] == ("a", "2024-01-02")  # dates come back as ISO text
    small = ops.bounded_select(spark, "with x as (select 1 as n) select n from x;", max_rows=5)
    assert not small.truncated and small.rows == [(1,)]
    for bad in ["DROP TABLE t", "select 1; select 2", "with x as (select 1) insert into t select * from x", "",
                "create table x as select 1", "set a = b", "cache table t"]:
        with pytest.raises((ValueError, ParseException)):
            ops.bounded_frame(spark, bad)
    for good in ["select replace('a', 'a', 'b') as c -- a;b", "select 1 as c; -- done", r"select 'it\'s; ok' as c",
                 "with load as (select 1 as `set`) select `set` as c from load"]:
        assert ops.bounded_select(spark, good).columns == ["c"]
    assert not spark.catalog.tableExists("t")  # views are the query's own
    twice = ops.bounded_select(spark, "select a.video_id, b.video_id, 1 as `x``y` from t a join t b using (video_id)",
                               views={"t": df})
    assert twice.columns == ["video_id", "video_id", "x`y"] and not twice.truncated
    ordered = ops.bounded_select(spark, "select id from range(1000) order by id desc", max_rows=2)
    assert ordered.rows == [(999,), (998,)] and ordered.truncated


def test_sums_beyond_bigint_do_not_abort(spark):
    rows = [("a", "FR", "ES", 9 * 10 ** 18), ("b", "FR", "ES", 9 * 10 ** 18), ("c", "ES", "ES", 5)]
    t = spark.createDataFrame(rows, "video_id string, channel_country string, video_trending_country string, "
                                    "video_view_count bigint")
    want = {("FR", "ES"): 2 ** 63 - 1, ("ES", "ES"): 5}
    for flows in (ops.country_flows(t, mode="all"), ops.country_flows_raw(t)):
        assert {(r.src, r.dst): r.views for r in flows.collect()} == want
        assert ops.flow_totals(flows).first().total_views == 2 ** 63 - 1


def test_map_counts_sums_colliding_keys(spark):
    names = spark.createDataFrame([("United States of America",), ("France",), ("Chad",)], "name string")
    counts = spark.createDataFrame([("USA", 3), ("United States", 4), ("france", 2), ("", 9), (None, 1)],
                                   "country string, cnt bigint")
    got = {r.name: r.cnt for r in ops.map_counts(names, counts).collect()}
    assert got == {"United States of America": 7, "France": 2, "Chad": 0}


def test_key_columns_follow_edits(spark, df):
    from trendlens.operators.filters import with_keys
    keyed = with_keys(df)
    new = ops.insert_rows(ops.update_rows(keyed, {"video_id": "NEW"}, "video_id = 'a'"), [{"video_id": "More"}])
    assert new.columns == keyed.columns
    assert all(r.video_key == (r.video_id or "").lower() for r in new.collect() if r.video_id is not None)
    assert ops.flows_of_video(new, " new ", mode="all").count() > 0
