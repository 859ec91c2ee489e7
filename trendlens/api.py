"""One object per dataset, one method per question the original endpoints
answered.

Methods return lazy DataFrames (and the totals as one-row DataFrames);
``fetch`` brings a bounded number of rows to the driver and says whether the
result was cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from trendlens import operators as ops
from trendlens.operators.fallback import check_unfiltered, usable
from trendlens.sources.edit import Saved
from trendlens.sources.rewrite import open_table

@dataclass
class Fetched:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


def fetch(df: DataFrame, max_rows: int) -> Fetched:
    """At most ``max_rows`` rows to the driver (``max_rows + 1`` are asked for
    so that ``truncated`` is known without a count)."""
    rows = [tuple(r) for r in df.limit(max_rows + 1).collect()]
    return Fetched(df.columns, rows[:max_rows], len(rows) > max_rows)


class TrendingData:
    """The clean table (and optionally the tag and raw tables) of one dataset.

    Tables are given as DataFrames or catalog names. Without a tag table,
    tag questions derive the tags from the clean table. Where the clean table
    is a name the catalog does not know, or has no day, country counts and flows
    are answered from the raw table; filters that it cannot serve are refused.

    Edits of a catalog table are saved: new rows are appended, an update or
    delete rewrites the files that hold hits (``sources.edit``). A tag table
    given by name follows the edits; one given as a DataFrame does not.
    """

    def __init__(self, spark: SparkSession, clean: DataFrame | str = "trending_clean",
                 tags: DataFrame | str | None = None, raw: DataFrame | str | None = None):
        self.spark = spark
        self._clean, self._tags, self._raw = clean, tags, raw

    def _df(self, t):
        return open_table(self.spark, t) if isinstance(t, str) else t

    @property
    def clean(self) -> DataFrame:
        return self._df(self._clean)

    def _fallback(self, on_date=None, start=None, end=None, mode="", sources=None) -> DataFrame | None:
        """The raw table where the clean one is missing, its filters checked."""
        if self._raw is None or not isinstance(self._clean, str) or usable(self.spark, self._clean) is not None:
            return None
        check_unfiltered(False, on_date, start, end, mode, sources)
        return self._df(self._raw)

    # -- maps ---------------------------------------------------------------
    def country_counts(self, on_date=None, start=None, end=None) -> tuple[DataFrame, DataFrame]:
        raw = self._fallback(on_date, start, end)
        counts = ops.country_counts(self.clean, on_date, start, end) if raw is None else ops.country_counts(raw)
        return counts, ops.country_counts_totals(counts)

    def country_flows(self, on_date=None, start=None, end=None, mode="", sources=None) -> tuple[DataFrame, DataFrame]:
        raw = self._fallback(on_date, start, end, mode, sources)
        flows = (ops.country_flows(self.clean, on_date, start, end, mode, sources) if raw is None
                 else ops.country_flows_raw(raw))
        return flows, ops.flow_totals(flows)

    def raw_flows(self) -> tuple[DataFrame, DataFrame]:
        flows = ops.country_flows_raw(self._df(self._raw) if self._raw is not None else self.clean)
        return flows, ops.flow_totals(flows)

    def flows_of_video(self, video_id, on_date=None, mode="") -> tuple[DataFrame, DataFrame]:
        flows = ops.flows_of_video(self.clean, video_id, on_date, mode)
        return flows, ops.flow_totals(flows)

    # -- pickers ------------------------------------------------------------
    def date_range(self) -> DataFrame:
        return ops.date_range(self.clean)

    def dates(self, display: bool = False) -> DataFrame:
        return ops.trending_dates(self.clean, display=display)

    def channels(self) -> DataFrame:
        return ops.channel_countries(self.clean)

    # -- listings (limit=None: all rows) --------------------------------------
    def videos(self, src=None, mode="", limit: int | None = 2000) -> DataFrame:
        return ops.top_videos(self.clean, src, mode, limit)

    def videos_on(self, on_date, src=None, mode="", limit: int | None = 1000) -> DataFrame:
        return ops.top_videos_on(self.clean, on_date, src, mode, limit)

    def videos_by_flow(self, on_date, src=None, dst=None, mode="", limit: int | None = 2000) -> DataFrame:
        return ops.videos_by_flow(self.clean, on_date, src, dst, mode, limit)

    def views_timeline(self, video_id, mode="") -> DataFrame:
        return ops.views_timeline(self.clean, video_id, mode)

    def tags(self, on_date=None, src=None, mode="", min_count: int = 2, limit: int | None = 100) -> DataFrame:
        tags = self._df(self._tags) if self._tags is not None else None
        return ops.top_tags(tags, self.clean, on_date, src, mode, min_count, limit)

    def top_channels(self, column: str = "channel_title", limit: int | None = 20) -> DataFrame:
        return ops.top_channels(self.clean, column, limit)

    # -- SQL page -----------------------------------------------------------
    def query(self, sql: str, max_rows: int = 1000, views: dict[str, DataFrame] | None = None,
              deadline: float | None = 300.0, max_pair_bytes: int | None = 1 << 40):
        return ops.bounded_select(self.spark, sql, max_rows, views, deadline, max_pair_bytes)

    def _saved(self) -> Saved | None:
        """The clean table in the catalog, with the tag table that follows it."""
        if not isinstance(self._clean, str):
            return None
        return Saved(self.spark, self._clean, self._tags if isinstance(self._tags, str) else None)

    def _edit(self, where: Column | str, edited, columns: set[str] | None) -> int:
        """Save the edited rows if any is hit; how many. ``columns``: those that change (None: rows go)."""
        saved = self._saved()
        if saved is not None:
            return saved.edit(where, edited, columns)
        hits = ops.rows_affected(self.clean, where)
        if hits:
            self._clean = edited(self.clean)
        return hits

    def update(self, assignments: dict, where: Column | str) -> int:
        return self._edit(where, lambda df: ops.update_rows(df, assignments, where), set(assignments))

    def delete(self, where: Column | str) -> int:
        return self._edit(where, lambda df: ops.delete_rows(df, where), None)

    def insert(self, rows) -> int:
        """Add rows given as mappings or as a DataFrame (INSERT ... SELECT); how many."""
        new = ops.inserted_rows(self.clean, rows)
        saved = self._saved()
        if saved is not None:
            return saved.insert(new)
        self._clean = self.clean.unionByName(new)
        return new.count()
