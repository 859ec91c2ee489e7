"""Row edits (UPDATE / INSERT / DELETE) as DataFrame -> DataFrame rewrites.

Parquet files are immutable, so an edit produces the new table as a lazy
DataFrame; ``trendlens.sources.tables.replace_table`` saves it. Predicates
follow SQL: a row whose predicate is NULL is neither updated nor deleted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.operators.filters import KEYS


def _pred(where: Column | str) -> Column:
    p = F.expr(where) if isinstance(where, str) else where
    return F.coalesce(p, F.lit(False))


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _keyed(new: DataFrame) -> DataFrame:
    """Stored key columns follow the columns they copy."""
    return new.withColumns({key: F.lower(F.col(c)) for c, key in KEYS.items()
                            if c in new.columns and key in new.columns})


def update_rows(df: DataFrame, assignments: Mapping[str, object], where: Column | str) -> DataFrame:
    """``UPDATE t SET c = v, ... WHERE p``: every right-hand side sees the old
    row (one ``select``), values are cast to the column's type."""
    unknown = set(assignments) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    hit = _pred(where)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [F.when(hit, _value(assignments[c]).cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in assignments else F.col(c) for c in df.columns]
    return _keyed(df.select(*cols))


def inserted_rows(df: DataFrame, rows: Sequence[Mapping[str, object]] | DataFrame) -> DataFrame:
    """The rows of ``INSERT INTO t (cols) VALUES ...`` in the table's columns:
    columns not named are NULL; values are cast to the table's types. ``rows``
    may also be a DataFrame (INSERT ... SELECT), aligned by column name."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(rows, DataFrame):
        new = rows
    else:
        rows = list(rows)
        # Values enter as text and are cast by Spark, so the caller may write
        # '2024-05-01' for a DATE column as in SQL.
        names = list(dict.fromkeys(k for r in rows for k in r))
        text = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
        data = [tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for r in rows]
        new = df.sparkSession.createDataFrame(data, text)
    unknown = set(new.columns) - set(types)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return _keyed(new.select(*((F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(t).alias(c)
                               for c, t in types.items())))


def insert_rows(df: DataFrame, rows: Sequence[Mapping[str, object]] | DataFrame) -> DataFrame:
    """The table with the new rows (see ``inserted_rows``)."""
    return df.unionByName(inserted_rows(df, rows))


def delete_rows(df: DataFrame, where: Column | str) -> DataFrame:
    """``DELETE FROM t WHERE p``: keeps rows where p is false or NULL."""
    return df.where(~_pred(where))


def affected(df: DataFrame, where: Column | str) -> DataFrame:
    """One row ``rows_affected``: how many rows an UPDATE or DELETE with this
    predicate touches (computed by the executors)."""
    return df.where(_pred(where)).agg(F.count(F.lit(1)).alias("rows_affected"))


def rows_affected(df: DataFrame, where: Column | str) -> int:
    """The same count, fetched: a single number reaches the driver."""
    return int(affected(df, where).first()["rows_affected"])
