"""Tag table and most frequent tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.functions.text import split_tags
from trendlens.operators import filters as flt
from trendlens.operators._common import cut


def explode_tags(df: DataFrame, tags: str = flt.TAGS, keys: tuple[str, ...] = (flt.VIDEO, flt.DAY),
                 with_position: bool = False) -> DataFrame:
    """``tag, <keys...>``: one row per usable tag of each row.

    The whole tag text is lower-cased, trimmed and split at every comma; each
    part is trimmed and kept when it has more than one character and no
    ``?``. Rows whose tag text is NULL or empty give nothing. Map-only: no
    shuffle. ``with_position`` adds ``tag_position``, the 1-based place of
    the part in the text (counting dropped parts), from ``posexplode``.
    """
    rows = df.where(F.col(tags).isNotNull() & (F.col(tags) != ""))
    if with_position:
        parts = rows.select(F.posexplode(split_tags(tags)).alias("_pos", "_part"), *keys)
        extra = [(F.col("_pos") + 1).alias("tag_position")]
    else:
        parts = rows.select(F.explode(split_tags(tags)).alias("_part"), *keys)
        extra = []
    tag = F.trim(F.col("_part"))
    return parts.where((F.length(tag) > 1) & ~tag.contains("?")).select(tag.alias("tag"), *keys, *extra)


def tag_changes(old: DataFrame | None, new: DataFrame | None, tags: str = flt.TAGS,
                keys: tuple[str, ...] = (flt.VIDEO, flt.DAY)) -> DataFrame:
    """``tag, <keys...>, n``: by how many rows the tag table changes where rows ``old`` become rows ``new``.

    Old rows count -1, new ones +1, both exploded and summed (partial sums first); what stays as it was is left out.
    """
    signed = [explode_tags(rows, tags, keys).withColumn("n", F.lit(sign))
              for rows, sign in ((old, -1), (new, 1)) if rows is not None]
    both = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return both.groupBy("tag", *keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def repeated(rows: DataFrame, count: str, most: int = 10_000) -> DataFrame:
    """Each row ``count`` times, without that column. Large counts are dealt out in pieces of ``most``, so that a hot
    row is not repeated by one task."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / most)))
    pieces = rows.where(F.col(count) > 0).withColumn("_piece", piece)
    size = F.least(F.lit(most).cast("long"), F.col(count) - F.col("_piece") * most)
    big = pieces.withColumn("_size", size)
    # Only what is repeated often is shuffled.
    parts = big.where(F.col(count) <= most).unionByName(big.where(F.col(count) > most).hint("rebalance"))
    return (parts.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))))
            .drop("_one", "_piece", "_size", count))


def changed_tags(rows: DataFrame, changes: DataFrame, keys: tuple[str, ...] = (flt.VIDEO, flt.DAY)) -> DataFrame:
    """The tag rows ``rows`` after ``changes`` (see ``tag_changes``): as many rows of a tag and key as their sum.

    Equal rows are counted before they meet their change, so a hot tag and key is one row per task.
    """
    counted = rows.groupBy("tag", *keys).agg(F.count(F.lit(1)).alias("n"))
    total = counted.unionByName(changes.select("tag", *keys, "n")).groupBy("tag", *keys).agg(F.sum("n").alias("n"))
    return repeated(total, "n").select(*rows.columns)


def top_tags(tags: DataFrame | None, df: DataFrame, on_date=None, src: str | None = None, mode: str | None = "",
             min_count: int = 2, limit: int | None = 100, *, video: str = flt.VIDEO, day: str = flt.DAY,
             src_col: str = flt.SRC, dst_col: str = flt.DST, tags_col: str = flt.TAGS) -> DataFrame:
    """``tag, tag_count``: how often each tag meets a matching row of ``df``
    on (video, day), at least ``min_count``, most frequent first.

    The count is that of the inner join tags x rows on (video, day), which is
    many-to-many: a key with k rows of a tag and k' matching rows counts
    k x k'. The pairs are never emitted: the row side is first reduced to one
    row per key carrying k' (a partial + final aggregate), so the join is
    many-to-one and each tag row just carries its key's k' into a sum per tag
    (map-side partial sums, then a shuffle of one row per tag and task). A
    key holding a third of all tag rows is one row on the other side; AQE's
    skew-join handling splits its partition if the join is shuffled.

    ``tags=None`` means the tag table is ``explode_tags(df)`` itself. Then the
    per-key counts are joined to the rows holding tag text -- one row per
    source row instead of one per tag -- and the text is exploded after the
    join: the same sums from a join several times smaller.
    """
    rows = flt.where(df, flt.day_filter(on_date, day=day), flt.equals_ci(df, src_col, src),
                     flt.flow_mode(mode, src_col, dst_col))
    matches = rows.groupBy(video, day).agg(F.count(F.lit(1)).alias("_rows"))
    if tags is None:
        texts = df.where(F.col(tags_col).isNotNull() & (F.col(tags_col) != "")).select(video, day, tags_col)
        weighted = explode_tags(texts.join(matches, [video, day]), tags=tags_col, keys=("_rows",))
    else:
        usable = tags.where(F.col("tag").isNotNull() & (F.length(F.trim(F.col("tag"))) > 0))
        weighted = usable.select("tag", video, day).join(matches, [video, day])
    counted = weighted.groupBy("tag").agg(F.sum("_rows").alias("tag_count"))
    return cut(counted.where(F.col("tag_count") >= int(min_count))
               .orderBy(F.desc("tag_count"), F.asc("tag")), limit)
