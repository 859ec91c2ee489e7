"""Plan shapes that the scale story depends on, plus a hot-key run.

The small data cannot show a hot key hurting, but the plans decide it: these
tests pin the operators that keep a hot video, country or (video, day) key
from landing whole in one task.
"""

import contextlib
import datetime as dt
import io
import re

import pytest
from pyspark.sql import functions as F

from trendlens import operators as ops
from trendlens.plans import standins as st


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def tree(df) -> str:
    return plan(df).split("\n\n")[0]


@pytest.fixture(scope="module")
def hot(spark):
    """One video ('hot') holds a third of the rows, all in one country pair
    and on one day; the rest is spread out."""
    d = dt.date(2024, 1, 1)
    rows = [("hot", "H", "FR", "ES", d, i, 1, "a,bb,cc") for i in range(3000)]
    rows += [(f"v{i}", "T", f"C{i % 7}", f"C{i % 5}", d + dt.timedelta(days=i % 30), i % 100, 2, "bb,dd")
             for i in range(6000)]
    return spark.createDataFrame(rows, "video_id string, video_title string, channel_country string, "
                                       "video_trending_country string, video_trending_date date, "
                                       "video_view_count bigint, video_like_count bigint, video_tags string"
                                 ).repartition(8)


def test_top1_is_cut_before_the_shuffle(hot):
    t = tree(ops.top_videos(hot, mode="all"))
    # partial WindowGroupLimit below the exchange, final one above it
    assert re.search(r"WindowGroupLimit.*\n.*Sort.*\n.*Exchange.*\n.*WindowGroupLimit", t, re.S)
    assert "TakeOrderedAndProject" in t
    best = ops.top_videos(hot, mode="all", limit=1).first()
    assert (best.video_id, best.views) == ("hot", 2999)


def test_distinct_count_shuffles_on_country_and_video_first(hot):
    p = plan(ops.country_counts(hot))
    exchanges = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", p)
    assert "video_id" in exchanges[0] and "video_id" not in exchanges[-1]
    got = {r.country: r.cnt for r in ops.country_counts(hot).collect()}
    assert got["ES"] == 1 and got["C0"] == 6000 // 5


def test_flows_are_two_partial_aggregations_without_expand(hot):
    for q in (ops.country_flows(hot, mode="all"), ops.country_flows_raw(hot)):
        t = tree(q)
        assert "Expand" not in t
        assert len(re.findall(r"HashAggregate", t)) == 4


def test_tag_join_is_many_to_one(hot):
    q = ops.top_tags(None, hot, mode="all")
    t = tree(q)
    assert "Expand" not in t and "Generate" in t
    # the row side is aggregated to one row per (video, day) before the join
    assert re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", t)
    got = {r.tag: r.tag_count for r in q.collect()}
    # hot key: 3000 source rows x 3000 matching rows for each of its tags
    assert got["cc"] == 3000 * 3000 and got["bb"] == 3000 * 3000 + 6000


def test_day_filters_reach_the_scan(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    spark.range(10).select(F.col("id").cast("string").alias("video_id"),
                           F.lit("x").alias("video_trending_country"),
                           F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int"))
                           .alias("video_trending_date")).write.parquet(path)
    p = plan(ops.country_counts(spark.read.parquet(path), start="2024-01-03", end="2024-01-05"))
    assert "GreaterThanOrEqual(video_trending_date,2024-01-03)" in p
    assert "LessThanOrEqual(video_trending_date,2024-01-05)" in p
    assert re.search(r"ReadSchema: struct<video_id:string,video_trending_country:string,"
                     r"video_trending_date:date>", p)


def test_video_lookup_reaches_the_scan(spark):
    from trendlens.plans.tables import trending_table
    t = trending_table(spark, "/root/testdata/sf0.001")
    for q in (ops.flows_of_video(t, " v17 ", mode="all"), ops.views_timeline(t, "V17", mode="all")):
        assert "EqualTo(video_key,v17)" in plan(q)
    assert "EqualTo(channel_key,nation_3)" in plan(ops.top_videos(t, src="NATION_3"))


def test_clean_table_write_skips_row_groups(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq

    from trendlens.plans.tables import DAY, layout
    p = plan(layout(st.trending(spark, "/root/testdata/sf0.001"), (DAY,), (DAY, "video_id")))
    assert re.search(r"rangepartitioning\(video_trending_date#\d+ ASC NULLS FIRST, video_id", p)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout(st.trending(spark, "/root/testdata/sf0.01"), (DAY,), (DAY, "video_id")).write.parquet(f"{tmp_dir}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = []
    for name in glob.glob(f"{tmp_dir}/t/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            column = next(c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))
                          if c.path_in_schema == DAY)
            ranges.append((column.statistics.min, column.statistics.max))
    day = dt.date(1996, 3, 15)
    assert len(ranges) >= 6 and sum(a <= day <= b for a, b in ranges) <= 2


def test_stand_in_join_needs_no_forced_broadcast(spark):
    # with automatic broadcasting off (as for tables too big to broadcast),
    # the stand-in join still plans: shuffled joins only.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = tree(st.trending(spark, "/root/testdata/sf0.001"))
        assert "BroadcastExchange" not in t and "SortMergeJoin" in t
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_video_reads_few_row_groups(spark, tmp_dir):
    """The table is laid out by day; Bloom filters tell which row groups hold a video."""
    from trendlens.operators.filters import with_keys
    from trendlens.sources import save_table
    rows = spark.range(4000).selectExpr(
        "concat('V', if(id = 777, 'one', cast(hash(id) % 900 as string))) AS video_id", "'FR' AS channel_country",
        "date_add(DATE'2024-01-01', cast(id % 100 as int)) AS video_trending_date")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.read.parquet(save_table(with_keys(rows), f"{tmp_dir}/t", ("video_trending_date",),
                                              ("video_trending_date", "video_id")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = len(table.inputFiles())
    assert files == int(before) and files > 4
    one = table.where("video_key = 'vone'")
    got = one.collect()
    assert [r.video_id for r in got] == ["Vone"]
    # Rows that leave the scan: those of the row groups (one per file here) that were read.
    scan = one._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < 2 * 4000 / files < table.count()


def test_bucketed_tables_join_without_a_shuffle(spark):
    import uuid

    from trendlens.plans.bucketed import HotKey, bucketed_pair, save_bucketed
    rows = [(f"v{i % 90}", "FR", ("ES", "FR")[i % 2], dt.date(2024, 1, 1) + dt.timedelta(days=i % 20), "a,bb,cc,bb") for i in range(1800)]
    clean = spark.createDataFrame(rows, "video_id string, channel_country string, video_trending_country string, "
                                        "video_trending_date date, video_tags string")
    name = f"bucketed_{uuid.uuid4().hex}"
    stored, tags = bucketed_pair(spark, clean, name, 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = ops.top_tags(tags, stored, mode="all", min_count=1)
        t = tree(q)
        # The only shuffle is that of the partial sums per tag.
        assert len(re.findall(r"Exchange", t)) == 1 and t.index("SortMergeJoin") > t.index("Exchange")
        got = [tuple(r) for r in q.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [tuple(r) for r in ops.top_tags(None, clean, mode="all", min_count=1).collect()]
    assert len(stored.inputFiles()) <= 4
    with pytest.raises(HotKey):
        save_bucketed(spark, clean.withColumn("video_id", F.expr("if(video_id < 'v5', 'hot', video_id)"))
                      .withColumn("video_trending_date", F.lit(dt.date(2024, 1, 1))), f"hot_{name}", 4)
