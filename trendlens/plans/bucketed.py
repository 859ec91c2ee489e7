"""The clean and tag tables bucketed by (video, day), so that their join needs no shuffle.

Both tables are dealt once, by the hash that Spark's join and aggregate want, one sorted file per bucket.
``top_tags`` of them counts rows per key and joins within each bucket; the first shuffle is that of the tag sums.

A bucket is read by one task, which Spark cannot split. So tables are only bucketed if no key holds more than
MOST_SHARE of a bucket's even share of rows; otherwise the shuffled join stays, where AQE splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.operators import filters as flt
from trendlens.operators.tags import explode_tags
from trendlens.session import shared_path

KEYS = (flt.VIDEO, flt.DAY)
MOST_SHARE = 0.5
BUCKET_ROWS = 500_000


class HotKey(ValueError):
    """One (video, day) holds too many rows for a bucket."""


def largest_key(df: DataFrame) -> int:
    """Rows of the most frequent (video, day): one number reaches the driver."""
    return df.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0


def enough_buckets(df: DataFrame, least: int) -> int:
    """Buckets of at most about BUCKET_ROWS rows: one task sorts and reads a bucket."""
    return max(least, -(-df.count() // BUCKET_ROWS))


def save_bucketed(spark: SparkSession, df: DataFrame, table: str, buckets: int) -> DataFrame:
    """``df`` as catalog table ``table`` in ``buckets`` files by (video, day), sorted; ``HotKey`` if a key is too frequent."""
    rows, hot = df.count(), largest_key(df)
    if hot > max(1, MOST_SHARE * rows / buckets):
        raise HotKey(f"{hot} of {rows} rows have one video and day; {buckets} buckets would not share them evenly")
    # One task, and so one file, per bucket.
    (df.repartition(buckets, *KEYS).sortWithinPartitions(*KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS)
     .option("path", shared_path(spark, "trendlens-tables", table)).saveAsTable(table))
    return spark.table(table)


def bucketed_pair(spark: SparkSession, clean: DataFrame, name: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(clean, tags) as bucketed tables ``<name>_clean`` and ``<name>_tags``."""
    stored = save_bucketed(spark, clean, f"{name}_clean", buckets)
    return stored, save_bucketed(spark, explode_tags(stored), f"{name}_tags", buckets)
