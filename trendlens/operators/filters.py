"""Composable predicates shared by the query operators.

Each returns a Column (or None for "no condition"); ``all_of`` joins them
with AND. Values always enter as literals -- no SQL text is spliced -- and the
predicates are plain comparisons, so Catalyst pushes the date ones into the
Parquet scan (and prunes date partitions when the table is partitioned).
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default column names of the clean table.
VIDEO = "video_id"
TITLE = "video_title"
DAY = "video_trending_date"
SRC = "channel_country"
DST = "video_trending_country"
VIEWS = "video_view_count"
LIKES = "video_like_count"
COMMENTS = "video_comment_count"
TAGS = "video_tags"
CHANNEL = "channel_title"

# Stored lower-case copies of columns that are matched case-blind: comparing
# one with a literal reaches the scan, a lower() around a column does not.
KEYS = {VIDEO: "video_key", SRC: "channel_key"}

INTERNATIONAL = ("on", "international")
DOMESTIC = ("off", "domestic", "")
ALL = "all"

_DAY_RE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def parse_day(value: str | _dt.date | None) -> _dt.date | None:
    """``'YYYY-MM-DD'`` (blanks allowed around) or a date -> date; empty -> None.

    A text of the right shape that is not a calendar day (``2024-13-45``) is
    an error, as is any other shape.
    """
    if value is None:
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    text = str(value).strip()
    if not text:
        return None
    if not _DAY_RE.match(text):
        raise ValueError(f"expected YYYY-MM-DD, got {value!r}")
    return _dt.date.fromisoformat(text)


def all_of(*preds: Column | None) -> Column | None:
    out = None
    for p in preds:
        if p is None:
            continue
        out = p if out is None else (out & p)
    return out


def where(df, *preds: Column | None):
    """Apply the AND of the given predicates (None ones ignored)."""
    p = all_of(*preds)
    return df if p is None else df.where(p)


def day_filter(on_date=None, start=None, end=None, day: str = DAY) -> Column | None:
    """One day (wins over a range), else an inclusive open or closed range.
    All three values are checked, even those a given day makes unused."""
    d, lo, hi = parse_day(on_date), parse_day(start), parse_day(end)
    if d is not None:
        return F.col(day) == F.lit(d)
    return all_of(F.col(day) >= F.lit(lo) if lo else None, F.col(day) <= F.lit(hi) if hi else None)


def _norm(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def flow_mode(mode: str | None = "", src: str = SRC, dst: str = DST) -> Column | None:
    """``on``/``international``: the lower-trimmed countries differ;
    ``off``/``domestic``/empty (the default): they are equal; ``all``: no
    condition. Any other text is refused. A NULL country drops the row in
    both filtering modes.
    """
    m = (mode or "").strip().lower()
    if m in INTERNATIONAL:
        return _norm(src) != _norm(dst)
    if m in DOMESTIC:
        return _norm(src) == _norm(dst)
    if m == ALL:
        return None
    raise ValueError(f"unknown mode {mode!r}: use international, domestic or all")


def nonblank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(F.trim(F.col(c))) > 0)


def sources_in(values: Iterable[str] | str | None, src: str = SRC) -> Column | None:
    """Case-blind, trimmed membership in a list of source countries.

    Accepts a list or a comma-separated text; blank entries are skipped; an
    empty list means no condition.
    """
    if values is None:
        return None
    if isinstance(values, str):
        values = values.split(",")
    wanted = sorted({v.strip().lower() for v in values if v is not None and v.strip()})
    if not wanted:
        return None
    return _norm(src).isin(wanted)


def with_keys(df):
    """``df`` with the lower-case copies of ``KEYS`` for the columns it has."""
    return df.withColumns({key: F.lower(F.col(c)) for c, key in KEYS.items() if c in df.columns})


def equals_ci(df, c: str, value: str | None) -> Column | None:
    """``lower(c) = lower(value.strip())``; the column itself is not trimmed.
    Blank or missing value: no condition. Uses the stored key column if ``df`` has it."""
    if value is None or not str(value).strip():
        return None
    key = KEYS.get(c)
    column = F.col(key) if key in df.columns else F.lower(F.col(c))
    return column == F.lit(str(value).strip().lower())
