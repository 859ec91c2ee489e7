"""Operators on generated tables against a plain Python model (many ties,
NULLs, blanks, case variants and hot keys)."""

import collections
import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trendlens import operators as ops

SETTINGS = settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
SCHEMA = ("video_id string, video_title string, channel_country string, video_trending_country string, "
          "video_trending_date date, video_view_count bigint, video_like_count bigint, "
          "video_comment_count bigint, video_tags string")
Row = collections.namedtuple("Row", "video title src dst day views likes comments tags")

countries = st.sampled_from(["FR", "fr", " FR ", "ES", "Es", "", " ", None])
row = st.builds(
    Row,
    st.sampled_from(["a", "A", "b", "c", "hot", None]),
    st.sampled_from(["t1", "t2", None]),
    countries, countries,
    st.sampled_from([dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]),
    st.sampled_from([0, 5, 5, 9, -3, None]),
    st.sampled_from([1, 1, 2, None]),
    st.sampled_from([0, 3, None]),
    st.sampled_from(["x,yy", "yy, zz ,yy", "", None, "q?,ww", " YY "]),
)
tables = st.lists(row, min_size=1, max_size=80)


def number(x):
    """A count as it is read: a sign, the first character that is no digit, is dropped."""
    return None if x is None else abs(x)


def grouped(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def largest(values):
    return max((v for v in values if v is not None), default=None)


def same(df, expected):
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, expected))


def named(rows):
    return [r for r in rows if (r.src or "").strip(" ") and (r.dst or "").strip(" ")]


def fold(c):
    return None if c is None else c.strip(" ").lower()


@SETTINGS
@given(tables)
def test_flows(spark, rows):
    edges = collections.defaultdict(list)
    for (src, dst, _), group in grouped([r for r in named(rows) if fold(r.src) != fold(r.dst)],
                                        lambda r: (r.src, r.dst, r.video)).items():
        edges[src, dst].append(largest(number(r.views) for r in group) or 0)
    same(ops.country_flows(spark.createDataFrame(rows, SCHEMA), mode="international"),
         [(*edge, len(tops), sum(tops)) for edge, tops in edges.items()])


@SETTINGS
@given(tables)
def test_counts_and_raw_flows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    videos = lambda group: len({r.video for r in group} - {None})
    same(ops.country_counts(df), [(c, videos(g)) for c, g in grouped(rows, lambda r: r.dst).items()])
    same(ops.country_flows_raw(df),
         [(*edge, videos(g), sum(number(r.views) or 0 for r in g))
          for edge, g in grouped(named(rows), lambda r: (r.src, r.dst)).items()])


@SETTINGS
@given(tables)
def test_top_videos_with_ties(spark, rows):
    last = lambda x: (x is None, x or "")  # noqa: E731  NULLs last

    def shown(r):
        return r.video, r.title or "", number(r.views) or 0, number(r.likes) or 0, r.src, r.dst

    def order(s):
        return -s[2], -s[3], s[1], last(s[4]), last(s[5])

    best = [min(map(shown, g), key=order) for g in grouped(rows, lambda r: r.video).values()]
    same(ops.top_videos(spark.createDataFrame(rows, SCHEMA), mode="all", limit=3),
         sorted(best, key=lambda s: (-s[2], last(s[0])))[:3])


@SETTINGS
@given(tables)
def test_top_tags_both_paths(spark, rows):
    counts = collections.Counter()
    for t in rows:
        for tag in re.split(",", (t.tags or "").strip(" ").lower()):
            tag = tag.strip(" ")
            if len(tag) > 1 and "?" not in tag:
                counts[tag] += sum(m.video == t.video and m.day == t.day and None not in (m.video, m.day)
                                   and None not in (m.src, m.dst) and fold(m.src) == fold(m.dst) for m in rows)
    want = sorted(((t, n) for t, n in counts.items() if n), key=lambda x: (-x[1], x[0]))[:2]
    df = spark.createDataFrame(rows, SCHEMA)
    same(ops.top_tags(None, df, min_count=1, limit=2), want)
    same(ops.top_tags(ops.explode_tags(df), df, min_count=1, limit=2), want)


@SETTINGS
@given(tables)
def test_timeline(spark, rows):
    want = []
    for (video, day), g in grouped([r for r in rows if r.day], lambda r: (r.video, r.day)).items():
        v, l, c = (largest(number(x) for x in column) or 0
                   for column in ([r.views for r in g], [r.likes for r in g], [r.comments for r in g]))
        want.append((video, str(day), v, l, c, round((l + c) * 100.0 / v, 4) if v else 0.0))
    same(ops.views_timeline(spark.createDataFrame(rows, SCHEMA), mode="all"), want)
