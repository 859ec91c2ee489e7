"""Distinct videos per trending country (and the totals shown with them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.operators import filters as flt
from trendlens.operators._common import zero_if_null


def country_counts(df: DataFrame, on_date=None, start=None, end=None, *,
                   country: str = flt.DST, video: str = flt.VIDEO, day: str = flt.DAY) -> DataFrame:
    """``country, cnt``: number of distinct non-NULL video ids per trending
    country. A NULL or blank country is a group of its own.

    Plan: the day predicate reaches the scan; ``countDistinct`` becomes a
    partial aggregate on (country, video) -- spread over videos, so a country
    holding a third of all rows still splits across tasks -- then a second
    partial/final count per country.
    """
    rows = flt.where(df, flt.day_filter(on_date, start, end, day=day))
    return rows.groupBy(F.col(country).alias("country")).agg(F.countDistinct(video).alias("cnt"))


def country_counts_totals(counts: DataFrame) -> DataFrame:
    """One row ``total, max_count``: sum of the per-country counts (not a
    global distinct count) and the largest one; 0 and 0 when empty."""
    return counts.agg(zero_if_null(F.sum("cnt")).alias("total"),
                      zero_if_null(F.max("cnt")).alias("max_count"))
