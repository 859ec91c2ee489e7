"""Raw snapshot table -> clean table (the typed 25-column table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.functions.parsing import (clock_parts, duration_seconds_from, french_date_from, french_parts,
                                         to_bigint, to_boolean, ts_fields, ts_from)

TEXT_COLUMNS = (
    "video_id", "channel_id", "channel_title", "video_title", "video_description", "channel_description",
    "video_default_thumbnail", "video_tags", "video_dimension", "video_definition", "video_trending_country",
    "channel_country", "video_category_id",
)
COUNT_COLUMNS = (
    "video_view_count", "video_like_count", "video_comment_count", "channel_view_count",
    "channel_subscriber_count", "channel_video_count",
)
TIME_COLUMNS = ("video_published_at", "channel_published_at")
# The raw export spells the trending day with two underscores.
RAW_TRENDING_DAY = "video_trending__date"
# The 24 raw columns the cleaning step reads, in the order of the export.
RAW_COLUMNS = (*TEXT_COLUMNS, "video_licensed_content", *COUNT_COLUMNS, *TIME_COLUMNS,
               RAW_TRENDING_DAY, "video_duration")


def clean_trending(raw: DataFrame, exact_duration: bool = False) -> DataFrame:
    """The clean table: 13 text columns, the licensed flag, 6 counts, 2
    timestamps, the trending day parsed from French text, the duration text
    and ``video_duration_seconds``.

    Built-in expressions only: map-only, no shuffle; unparseable cells become
    NULL.
    """
    # The two regex rewrites that the day and duration parsers read several
    # times are computed once, in a projection of their own (Catalyst keeps
    # it separate: an expensive expression read many times is not inlined).
    # The counts are parsed there too. Spark compiles a projection with a lambda
    # in small methods; without one, all parsers make a method too large for the
    # JVM to compile. So each of the two projections has a lambda.
    staged = raw.select("*", french_parts(RAW_TRENDING_DAY).alias("_day_parts"),
                        clock_parts("video_duration").alias("_clock_parts"),
                        F.transform(F.array(*(F.col(c) for c in TIME_COLUMNS)), ts_fields).alias("_times"),
                        *(to_bigint(c).alias(f"_{c}") for c in COUNT_COLUMNS))
    cols = [F.col(c).cast("string").alias(c) for c in TEXT_COLUMNS]
    cols.append(F.get(F.transform(F.array("video_licensed_content"), to_boolean), F.lit(0)).alias("video_licensed_content"))
    cols += [F.col(f"_{c}").alias(c) for c in COUNT_COLUMNS]
    cols += [ts_from(F.get("_times", F.lit(i))).alias(c) for i, c in enumerate(TIME_COLUMNS)]
    cols.append(french_date_from(RAW_TRENDING_DAY, "_day_parts").alias("video_trending_date"))
    cols.append(F.col("video_duration"))
    cols.append(duration_seconds_from("video_duration", "_clock_parts", exact=exact_duration)
                .alias("video_duration_seconds"))
    return staged.select(*cols)
