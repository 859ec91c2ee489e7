"""Country-to-country flows: channel country (src) -> trending country (dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.operators import filters as flt
from trendlens.operators._common import digits, require, total


def country_flows(df: DataFrame, on_date=None, start=None, end=None, mode: str | None = "",
                  sources=None, *, src: str = flt.SRC, dst: str = flt.DST, video: str = flt.VIDEO,
                  views: str = flt.VIEWS, day: str = flt.DAY) -> DataFrame:
    """``src, dst, cnt, views`` per edge: ``cnt`` videos on the edge, ``views``
    the sum over those videos of each one's LARGEST view count, so a video
    seen on many days counts once. Both countries must be non-blank.

    Plan: group by (src, dst, video) with a partial max (map-side combine,
    spread over videos), then by (src, dst) with partial count/sum: a hot
    country pair is pre-reduced per task before its single final group.
    """
    rows = flt.where(df, flt.nonblank(src), flt.nonblank(dst), flt.day_filter(on_date, start, end, day=day),
                     flt.flow_mode(mode, src, dst), flt.sources_in(sources, src))
    per_video = (rows.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(video))
                 .agg(F.max(digits(rows, views)).alias("views")))
    return per_video.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"),
                                               total("views").alias("views"))


def country_flows_raw(df: DataFrame, *, src: str = flt.SRC, dst: str = flt.DST, video: str = flt.VIDEO,
                      views: str = flt.VIEWS) -> DataFrame:
    """The simpler flows used when no clean table exists: no day or mode
    filter, distinct videos per edge and the plain sum of all view counts.

    ``COUNT(DISTINCT video)`` next to ``SUM`` would be planned with an Expand
    (every row twice); grouping by (src, dst, video) first with a partial sum,
    then counting the non-NULL videos and summing the sums per edge, gives
    the same numbers in two plain aggregations.
    """
    rows = flt.where(df, flt.nonblank(src), flt.nonblank(dst))
    per_video = (rows.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(video).alias("_video"))
                 .agg(F.when(F.count(digits(rows, views)) > 0, total(digits(rows, views))).alias("_views")))
    return per_video.groupBy("src", "dst").agg(F.count("_video").alias("cnt"),
                                               total("_views").alias("views"))


def flow_totals(flows: DataFrame) -> DataFrame:
    """One row ``total, total_views`` over a flow result (0 when empty)."""
    return flows.agg(total("cnt").alias("total"), total("views").alias("total_views"))


def flows_of_video(df: DataFrame, video_id: str, on_date=None, mode: str | None = "", *,
                   src: str = flt.SRC, dst: str = flt.DST, video: str = flt.VIDEO, views: str = flt.VIEWS,
                   day: str = flt.DAY) -> DataFrame:
    """``src, dst, cnt, views`` for one video (id matched case-blind): rows
    and the plain sum of view counts per edge -- no per-video de-duplication
    here, unlike ``country_flows``."""
    require(video_id, "video_id")
    rows = flt.where(df, flt.equals_ci(df, video, video_id), flt.day_filter(on_date, day=day),
                     flt.flow_mode(mode, src, dst))
    return (rows.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"))
            .agg(F.count(F.lit(1)).alias("cnt"), total(digits(rows, views)).alias("views")))
