"""Counts from bitmaps, and ad-hoc queries that end."""

import datetime as dt
import random
import time

import pytest

from trendlens import operators as ops
from trendlens.plans.tables import write_table

SCHEMA = "video_id string, video_trending_country string, video_trending_date date"


def rows(seed, n):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, *[dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(9)]])
    out = [(rng.choice([None, *[f"v{k}" for k in range(60)]]), rng.choice([None, "", "FR", "ES", "DE"]), day())
           for _ in range(n)]
    return out + [(None, "only null videos", dt.date(2024, 1, 3)), (None, "only null videos", None)]


def bitmaps_of(spark, df):
    return ops.day_bitmaps(df, ops.numbered(write_table(spark, ops.video_numbers(df), "numbers")))


@pytest.mark.parametrize("seed,n", [(1, 800), (2, 5), (3, 0)])
def test_counts_of_any_range(spark, seed, n):
    df = spark.createDataFrame(rows(seed, n), SCHEMA).repartition(5)
    stored = write_table(spark, bitmaps_of(spark, df), "bitmaps")
    for days in ({}, {"start": "2024-01-02"}, {"start": "2024-01-02", "end": "2024-01-06"}, {"on_date": "2024-01-03"},
                 {"end": "2023-01-01"}):
        want = {r.country: r.cnt for r in ops.country_counts(df, **days).collect()}
        assert {r.country: r.cnt for r in ops.counts_from_bitmaps(stored, **days).collect()} == want


def test_numbers_are_dense_and_many_buckets_are_summed(spark):
    df = spark.range(70_000).selectExpr("concat('v', id) AS video_id", "if(id % 2 = 0, 'FR', 'ES') AS video_trending_country",
                                        "date_add(DATE'2024-01-01', cast(id % 3 as int)) AS video_trending_date")
    numbers = ops.numbered(write_table(spark, ops.video_numbers(df), "numbers"))
    got = sorted(r.number for r in numbers.collect())
    assert got == list(range(1, 70_001))
    stored = write_table(spark, ops.day_bitmaps(df, numbers), "bitmaps")
    assert stored.select("bucket").distinct().count() == 3
    assert {r.country: r.cnt for r in ops.counts_from_bitmaps(stored).collect()} == {"FR": 35_000, "ES": 35_000}
    one = {r.country: r.cnt for r in ops.counts_from_bitmaps(stored, on_date="2024-01-02").collect()}
    assert one == {r.country: r.cnt for r in ops.country_counts(df, on_date="2024-01-02").collect()}


def test_counts_read_no_video_ids(spark):
    stored = write_table(spark, bitmaps_of(spark, spark.createDataFrame(rows(1, 50), SCHEMA)), "bitmaps")
    assert stored.columns == ["country", "day", "bucket", "bits"]


PAIRS = "SELECT sum(hash(a.id, b.id)) AS s FROM range(3000000) a JOIN range(3000000) b ON a.id <> b.id"


LONG = "SELECT sum(hash(id)) AS s FROM range(100000000000000)"


def test_a_query_ends_at_its_deadline(spark):
    began = time.time()
    with pytest.raises(ops.DeadlineExceeded, match="2 s"):
        ops.bounded_select(spark, LONG, deadline=2)
    assert time.time() - began < 30
    end = time.time() + 10
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < end:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    # The session goes on, and later jobs are in no cancelled group.
    assert ops.bounded_select(spark, "SELECT 1 AS x", deadline=60).rows == [(1,)]
    assert spark.range(5).count() == 5


def test_large_pair_joins_are_refused(spark):
    with pytest.raises(ops.TooLarge):
        ops.bounded_select(spark, PAIRS, max_pair_bytes=1 << 30)
    small = "SELECT count(*) AS n FROM range(30) a JOIN range(30) b ON a.id < b.id"
    assert ops.bounded_select(spark, small, max_pair_bytes=1 << 30).rows == [(435,)]
    equal = "SELECT count(*) AS n FROM range(300000) a JOIN range(300000) b ON a.id = b.id"
    assert ops.bounded_select(spark, equal, max_pair_bytes=1).rows == [(300000,)]


def test_errors_are_not_taken_for_deadlines(spark):
    with pytest.raises(Exception) as e:
        ops.bounded_select(spark, "SELECT nothing FROM nowhere", deadline=60)
    assert not isinstance(e.value, ops.DeadlineExceeded)
