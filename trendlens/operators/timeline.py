"""Daily views / likes / comments series and engagement rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.operators import filters as flt
from trendlens.operators._common import digits, zero_if_null


def views_timeline(df: DataFrame, video_id: str | None = None, mode: str | None = "", *,
                   video: str = flt.VIDEO, day: str = flt.DAY, views: str = flt.VIEWS, likes: str = flt.LIKES,
                   comments: str = flt.COMMENTS) -> DataFrame:
    """Per day (ISO text ``d``): the largest views, likes and comments of the
    matching rows and ``engagement_rate = round((likes+comments)*100/views, 4)``
    (0 when views is 0). Days that are NULL are left out.

    With ``video_id`` the series of that video (id matched case-blind),
    ordered by day; without it, the series of every video at once, keyed by
    ``video_id`` -- one grouped pass instead of one query per video, left
    unordered (a global sort of every video-day row would be the costliest
    step at scale and nothing needs it; sort per video when reading).
    """
    preds = (flt.equals_ci(df, video, video_id) if video_id is not None else None,
             F.col(day).isNotNull(), flt.flow_mode(mode))
    rows = flt.where(df, *preds)
    keys = [F.col(day)] if video_id is not None else [F.col(video).alias("video_id"), F.col(day)]
    daily = rows.groupBy(*keys).agg(zero_if_null(F.max(digits(rows, views))).alias("views"),
                                    zero_if_null(F.max(digits(rows, likes))).alias("likes"),
                                    zero_if_null(F.max(digits(rows, comments))).alias("comments"))
    # Aggregate once, then derive the rate; 100.0 is a DOUBLE literal here,
    # so the division is floating point, not DECIMAL.
    rate = F.when(F.col("views") > 0,
                  F.round((F.col("likes").cast("double") + F.col("comments")) * F.lit(100.0) / F.col("views"), 4)
                  ).otherwise(F.lit(0.0))
    lead = [] if video_id is not None else ["video_id"]
    out = daily.select(*lead, F.col(day).cast("string").alias("d"), "views", "likes", "comments",
                       rate.alias("engagement_rate"))
    return out.orderBy("d") if video_id is not None else out
