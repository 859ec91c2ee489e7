"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.functions.parsing import digits_bigint


def digits(df: DataFrame, name: str) -> Column:
    """The view/like/comment count as the original queries read it: first
    non-digit removed, then BIGINT. Uses the integral fast path when the
    column already holds integers."""
    return digits_bigint(F.col(name), df.schema[name].dataType)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def cut(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; all with None."""
    return df if limit is None else df.limit(int(limit))


def total(c: Column | str) -> Column:
    """Sum of counts (never negative) as BIGINT, 0 without any.

    A sum beyond BIGINT is reported as the largest BIGINT: one dirty cell
    must not abort the query.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == 0, F.lit(0).cast("bigint")).otherwise(
        F.coalesce(F.try_sum(c), F.lit(2 ** 63 - 1).cast("bigint")))


def require(value, name: str):
    if value is None or (isinstance(value, str) and not value.strip()):
        raise ValueError(f"{name} is required")
    return value
