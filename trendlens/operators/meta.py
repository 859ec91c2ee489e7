"""Lookups for pickers: day range, distinct days, distinct channel countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.functions.parsing import french_display
from trendlens.operators import filters as flt


def date_range(df: DataFrame, *, day: str = flt.DAY) -> DataFrame:
    """One row ``min_date, max_date`` as ISO text (NULLs on an empty table)."""
    return df.agg(F.min(day).cast("string").alias("min_date"), F.max(day).cast("string").alias("max_date"))


def trending_dates(df: DataFrame, *, day: str = flt.DAY, display: bool = False) -> DataFrame:
    """``d``: the distinct non-NULL days as ISO text, ascending. De-duplicated
    on the DATE value (4 bytes) before it is formatted. ``display`` adds
    ``d_display``, the same day as dd/MM/yyyy (as shown beside the map)."""
    days = df.where(F.col(day).isNotNull()).select(day).distinct()
    extra = [french_display(F.col(day)).alias("d_display")] if display else []
    return days.select(F.col(day).cast("string").alias("d"), *extra).orderBy("d")


def channel_countries(df: DataFrame, *, src: str = flt.SRC) -> DataFrame:
    """``channel_country``: distinct non-blank values (as stored), ascending."""
    return (df.where(flt.nonblank(src)).select(F.col(src).alias("channel_country")).distinct()
            .orderBy("channel_country"))
