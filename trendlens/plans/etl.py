"""CSV export -> clean table -> tag table, saved: the original's set-up step
(load the CSV, run the cleaning script) as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendlens.operators.filters import with_keys
from trendlens.operators.tags import explode_tags
from trendlens.plans.cleaning import clean_trending
from trendlens.sources.csv import read_csv
from trendlens.sources.tables import save_table

DAY = "video_trending_date"


def build_tables(spark: SparkSession, csv_path: str | list[str], clean_path: str, tags_path: str,
                 sep: str = ",", multiline: bool | None = None, exact_duration: bool = False,
                 mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """Read the CSV export(s) as text, clean them, and save the clean table
    and the tag table as Parquet; return both as read back from storage.

    The clean table also stores lower-case key columns for its case-blind
    filters. It is written once and the tag table is derived from the
    written files (not from the CSV again), so the text is parsed once. Both
    are laid out in ranges of (day, video) for the day filters of the queries.
    """
    clean = with_keys(clean_trending(read_csv(spark, csv_path, sep=sep, multiline=multiline), exact_duration=exact_duration))
    save_table(clean, clean_path, (DAY,), (DAY, "video_id"), mode=mode)
    stored = spark.read.schema(clean.schema).parquet(clean_path)
    save_table(stored.select("video_tags", "video_id", DAY), tags_path, (DAY,), (DAY, "video_id"), mode=mode, finish=explode_tags)
    return stored, spark.read.schema(explode_tags(stored).schema).parquet(tags_path)
