"""Saved edits of the clean table, with the tag table kept in step.

An update or delete finds the files that hold hits, and rewrites those only
(``rewrite_files``); where more than half of the files do, the table is written
anew in its layout: file by file, without a shuffle, where the files are in that
layout and the edit leaves its columns alone. An insert appends.

The tag table follows by a change set: the tags of the rows that leave count -1,
those of the rows that come +1. Additions are appended. Where tags go, the
files of the tag table that hold them are counted together with the change set
and rewritten. The change set is written before the clean table is switched, so it
holds what the edit saw.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.operators import filters as flt
from trendlens.operators.tags import changed_tags, repeated, tag_changes
from trendlens.session import file_by_file
from trendlens.sources.rewrite import files_with, open_table, read_files, rewrite_files
from trendlens.sources.tables import append_rows, replace_table

MOST_SHARE = 0.5     # share of files with hits beyond which the whole table is written anew
TAG_KEYS = (flt.VIDEO, flt.DAY)


class Saved:
    """A clean table in the catalog and, optionally, its tag table there (tag, video, day)."""

    def __init__(self, spark: SparkSession, clean: str, tags: str | None = None):
        self.spark, self.clean, self.tags = spark, clean, tags

    def _written(self, changes: DataFrame) -> DataFrame:
        from trendlens.plans.tables import write_table
        return write_table(self.spark, changes, "tag-changes")

    def edit(self, where: Column | str, edited: Callable[[DataFrame], DataFrame], columns: set[str] | None) -> int:
        """Save ``edited`` rows; how many rows ``where`` hits. ``columns``: those that change (None: rows leave)."""
        table = open_table(self.spark, self.clean)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        files = files_with(table, hit)
        hits = sum(files.values())
        if not hits:
            return 0
        changes = None
        if self.tags and (columns is None or columns & {flt.TAGS, *TAG_KEYS}):
            old = read_files(self.spark, self.clean, list(files)).where(hit)
            changes = self._written(tag_changes(old, None if columns is None else edited(old)))
        keys = tuple(c for c in (flt.DAY, flt.VIDEO) if c in table.columns)
        rewrite(self.spark, self.clean, list(files), edited, keys, in_place=columns is None or not columns & set(keys))
        if changes is not None:
            follow_tags(self.spark, self.tags, changes)
        return hits

    def insert(self, new: DataFrame) -> int:
        open_table(self.spark, self.clean)
        rows = self._written(new)  # counted, appended and exploded as one and the same
        append_rows(self.spark, rows, self.clean)
        if self.tags:
            follow_tags(self.spark, self.tags, tag_changes(None, rows))
        return rows.count()


def in_layout(table: DataFrame, day: str) -> bool:
    """Whether the files are ranges of days, one behind the other (NULL first): one row per file reaches the driver."""
    c = F.col(f"`{day}`")
    c = F.unix_date(c) if table.schema[day].dataType.simpleString() == "date" else c  # Python's dates end with the year 9999
    found = table.groupBy(F.col("_metadata.file_path")).agg(
        F.min(c).alias("low"), F.max(c).alias("high"), F.count(F.when(c.isNull(), 1)).alias("no_day")).collect()
    place = lambda d: (d is not None, d)
    ranges = sorted((place(None if r["no_day"] else r["low"]), place(r["high"])) for r in found)
    return all(before[1] <= after[0] for before, after in zip(ranges, ranges[1:]))


def rewrite(spark: SparkSession, table: str, files: list[str], edited: Callable[[DataFrame], DataFrame],
            sort_by: tuple[str, ...] = (), in_place: bool = False) -> None:
    """Replace the rows of ``files`` by ``edited`` of them; the whole table where they are most of it.

    ``in_place``: each edited row is made of one row and has its ``sort_by``, so a table in its layout stays in it.
    """
    whole = spark.table(table)
    if len(files) <= MOST_SHARE * len(whole.inputFiles()) \
            and rewrite_files(spark, table, files, edited(read_files(spark, table, files))):
        return
    if in_place and sort_by and in_layout(whole, sort_by[0]):
        with file_by_file(spark):
            replace_table(spark, edited(whole), table, sort_by=None)
    else:
        replace_table(spark, edited(whole), table, sort_by=sort_by)


def follow_tags(spark: SparkSession, tags: str, changes: DataFrame) -> None:
    """Bring the tag table up to date with ``changes`` (tag, video, day, n)."""
    table = open_table(spark, tags)
    gone = changes.where("n < 0").select("tag", *TAG_KEYS)
    added = changes.where("n > 0")
    days = gone.agg(F.min(flt.DAY).alias("low"), F.max(flt.DAY).alias("high"),
                    F.count(F.when(F.col(flt.DAY).isNull(), 1)).alias("no_day"), F.count(F.lit(1)).alias("n")).first()
    if days["n"]:
        # The days prune the scan; the join then finds the files.
        near = F.col(flt.DAY).between(F.lit(days["low"]), F.lit(days["high"]))
        near = near | F.col(flt.DAY).isNull() if days["no_day"] else near
        rows = table.select("tag", *TAG_KEYS, F.col("_metadata.file_path").alias("_file")).where(near).alias("t")
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("tag", *TAG_KEYS)]
        held = rows.join(gone.alias("g"), same[0] & same[1] & same[2], "left_semi")
        from urllib.parse import unquote
        files = [unquote(r["_file"]) for r in held.select("_file").distinct().collect()]
        if files:
            gone_only = changes.where("n < 0")
            rewrite(spark, tags, files, lambda df: _without(df, gone_only), (flt.DAY, flt.VIDEO))
    append_rows(spark, repeated(added, "n"), tags)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` less the changes: rows of other keys as they are, those of changed keys counted."""
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("tag", *TAG_KEYS)]
    on = same[0] & same[1] & same[2]
    others = rows.alias("t").join(gone.alias("g"), on, "left_anti")
    held = rows.alias("t").join(gone.alias("g"), on, "left_semi")
    return others.unionByName(changed_tags(held, gone, TAG_KEYS))
