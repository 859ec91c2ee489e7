"""Distinct videos of any range of days from stored bitmaps.

Videos are numbered once. Per country and day a bitmap holds one bit per video
(Spark's ``bitmap_*`` aggregates: 32,768 bits a row, more numbers in more rows). The
distinct videos of a range are the bits of its days' bitmaps OR-ed, exactly, without
reading a video id. Numbers follow the first day and country of a video, so videos that
trend together share few rows, and a row's zeros compress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlens.operators import filters as flt
from trendlens.session import send_package

MOST_OPEN = 8192  # bitmaps of 4 KB that a task holds


def video_numbers(df: DataFrame, *, country: str = flt.DST, video: str = flt.VIDEO, day: str = flt.DAY) -> DataFrame:
    """``video, first_day, first_country`` of every non-NULL video, in ranges of first day and country.

    To be written; ``numbered`` then gives numbers by file order.
    """
    first = F.min(F.struct(F.col(day).alias("day"), F.col(country).alias("country"))).alias("first")
    videos = df.where(F.col(video).isNotNull()).groupBy(F.col(video).alias("video")).agg(first)
    videos = videos.select("video", F.col("first.day").alias("first_day"), F.col("first.country").alias("first_country"))
    return (videos.repartitionByRange("first_day", "first_country", "video")
            .sortWithinPartitions("first_day", "first_country", "video")
            .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))


def numbered(stored: DataFrame) -> DataFrame:
    """``video, number``: dense numbers from 1, from the written ``video_numbers``."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written part
    starts = (stored.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("low"))
              .select("part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return stored.join(starts, "part").select("video", (F.col("start") + F.col("place") - F.col("low") + 1).alias("number"))


def day_bitmaps(df: DataFrame, numbers: DataFrame, *, country: str = flt.DST, video: str = flt.VIDEO,
                day: str = flt.DAY) -> DataFrame:
    """``country, day, bucket, bits``: one row per country, day and 32,768 video numbers with a bit set.

    Rows are made distinct before they meet the numbers. A country and day with NULL videos only has a row without
    a bucket, so that its country stays in the counts.
    """
    seen = df.select(F.col(country).alias("country"), F.col(day).alias("day"), F.col(video).alias("video")).distinct()
    known = seen.join(numbers, "video", "left")
    # Numbers are dealt to their bitmap before one is made: a bitmap takes 4 KB however few bits are set.
    dealt = known.select("country", "day", F.bitmap_bucket_number("number").alias("bucket"),
                         F.bitmap_bit_position("number").alias("bit")).repartition("country", "day", "bucket")
    return dealt.groupBy("country", "day", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of a country and bucket OR-ed, of MOST_OPEN keys at a time: a few MB a task, whatever it reads."""
    open_bits: dict[tuple, np.ndarray | None] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        keys = list(open_bits)
        for a in range(0, len(keys), 256):
            part = keys[a: a + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.int64()),
                 pa.array([open_bits[k].tobytes() for k in part], pa.binary())], names=["country", "bucket", "bits"])
        open_bits.clear()

    for batch in batches:
        for country, bucket, bits in zip(*(batch.column(c) for c in ("country", "bucket", "bits"))):
            key, words = (country.as_py(), bucket.as_py()), np.frombuffer(bits.as_buffer(), np.uint64)
            if key in open_bits:
                open_bits[key] |= words
            else:
                if len(open_bits) >= MOST_OPEN:
                    yield from rows()
                open_bits[key] = words.copy()
    yield from rows()


def counts_from_bitmaps(bitmaps: DataFrame, on_date=None, start=None, end=None) -> DataFrame:
    """``country, cnt`` as ``country_counts`` gives it for these days, from ``day_bitmaps``."""
    send_package(bitmaps.sparkSession)
    rows = flt.where(bitmaps, flt.day_filter(on_date, start, end, day="day"))
    # OR-ed within each task first: Spark's aggregate would sort all bitmaps a task reads.
    united = rows.select("country", "bucket", "bits").mapInArrow(_united, "country string, bucket long, bits binary")
    per_bucket = united.groupBy("country", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    return per_bucket.groupBy("country").agg(F.sum(bits).alias("cnt"))
