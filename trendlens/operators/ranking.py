"""Best row per video (or per video and edge), most viewed first; top channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlens.operators import filters as flt
from trendlens.operators._common import cut, digits, require, zero_if_null

VIDEO_COLUMNS = ("video_id", "video_title", "views", "likes", "src", "dst")

# Full order used to pick the best row of a group. Views decide; the rest
# breaks ties over every projected column, so the pick -- and any LIMIT cut
# after it -- is the same on every run and on every engine.
_BEST_FIRST = (("views", F.desc), ("likes", F.desc), ("video_title", F.asc), ("src", F.asc_nulls_last),
               ("dst", F.asc_nulls_last), ("video_id", F.asc_nulls_last))


def video_rows(df: DataFrame, *, video: str = flt.VIDEO, title: str = flt.TITLE, views: str = flt.VIEWS,
               likes: str = flt.LIKES, src: str = flt.SRC, dst: str = flt.DST) -> DataFrame:
    """Project the listing columns: id, title ('' for NULL), views and likes
    read as digits (0 for NULL), src and dst."""
    return df.select(F.col(video).alias("video_id"),
                     F.coalesce(F.col(title), F.lit("")).alias("video_title"),
                     zero_if_null(digits(df, views)).alias("views"),
                     zero_if_null(digits(df, likes)).alias("likes"),
                     F.col(src).alias("src"), F.col(dst).alias("dst"))


def best_row_per(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Top-1 row per group by ``_BEST_FIRST``.

    ``row_number() ... = 1`` is planned as a partial WindowGroupLimit before
    the shuffle and a final one after it: every task forwards at most one row
    per group, so a video holding a third of all rows is cut down map-side
    and never lands whole in one task.
    """
    order = [direction(name) for name, direction in _BEST_FIRST if name not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def _listing(df: DataFrame, preds, keys: tuple[str, ...], limit: int, cols: dict) -> DataFrame:
    rows = video_rows(flt.where(df, *preds), **cols)
    best = best_row_per(rows, keys)
    tie = [F.asc_nulls_last(k) for k in ("video_id", "src", "dst") if k in keys]
    # ORDER BY + LIMIT plans as TakeOrderedAndProject: a bounded top-k per
    # task, merged once -- no global sort of the candidates.
    return cut(best.orderBy(F.desc("views"), *tie), limit)


def _cols(video, title, views, likes, src, dst):
    return dict(video=video, title=title, views=views, likes=likes, src=src, dst=dst)


def top_videos(df: DataFrame, src: str | None = None, mode: str | None = "", limit: int | None = 2000, *,
               video: str = flt.VIDEO, title: str = flt.TITLE, views: str = flt.VIEWS, likes: str = flt.LIKES,
               src_col: str = flt.SRC, dst_col: str = flt.DST) -> DataFrame:
    """Best row of each video over all days, most viewed first, ``limit`` rows.
    ``src`` matches the channel country case-blind (column not trimmed)."""
    preds = (flt.equals_ci(df, src_col, src), flt.flow_mode(mode, src_col, dst_col))
    return _listing(df, preds, ("video_id",), limit, _cols(video, title, views, likes, src_col, dst_col))


def top_videos_on(df: DataFrame, on_date, src: str | None = None, mode: str | None = "", limit: int | None = 1000, *,
                  video: str = flt.VIDEO, title: str = flt.TITLE, views: str = flt.VIEWS,
                  likes: str = flt.LIKES, src_col: str = flt.SRC, dst_col: str = flt.DST,
                  day: str = flt.DAY) -> DataFrame:
    """Same as ``top_videos`` for one (required) day."""
    require(flt.parse_day(on_date), "on_date")
    preds = (flt.day_filter(on_date, day=day), flt.equals_ci(df, src_col, src), flt.flow_mode(mode, src_col, dst_col))
    return _listing(df, preds, ("video_id",), limit, _cols(video, title, views, likes, src_col, dst_col))


def videos_by_flow(df: DataFrame, on_date, src: str | None = None, dst: str | None = None,
                   mode: str | None = "", limit: int | None = 2000, *, video: str = flt.VIDEO, title: str = flt.TITLE,
                   views: str = flt.VIEWS, likes: str = flt.LIKES, src_col: str = flt.SRC,
                   dst_col: str = flt.DST, day: str = flt.DAY) -> DataFrame:
    """Best row per (video, src, dst) on one (required) day, optionally for
    one source and/or one destination (case-blind, not trimmed)."""
    require(flt.parse_day(on_date), "on_date")
    preds = (flt.day_filter(on_date, day=day), flt.equals_ci(df, src_col, src), flt.equals_ci(df, dst_col, dst),
             flt.flow_mode(mode, src_col, dst_col))
    return _listing(df, preds, ("video_id", "src", "dst"), limit,
                    _cols(video, title, views, likes, src_col, dst_col))


def top_channels(df: DataFrame, column: str = flt.CHANNEL, limit: int | None = 20) -> DataFrame:
    """``<column>, videos``: the channels with most rows (ties by name)."""
    return cut(df.groupBy(column).agg(F.count(F.lit(1)).alias("videos"))
               .orderBy(F.desc("videos"), F.asc_nulls_last(column)), limit)
