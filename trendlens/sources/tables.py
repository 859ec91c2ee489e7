"""Saving tables: a new table, new contents for an existing one, more rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendlens.session import shared_path, shuffles_dropped
from trendlens.sources.rewrite import Files, location, quoted, recover, switch_table


def replace_table(spark: SparkSession, df: DataFrame, table: str, root: str | None = None,
                  sort_by: tuple[str, ...] | None = (), finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Save ``df`` as catalog table ``table``, replacing its contents, schema included.

    The rows are written to a new folder (below ``root``, by default the
    shared folder of ``spark.checkpoint.dir``) and only then is the table
    pointed at it. An edit reads the table it replaces, so nothing being read
    is overwritten; lost executors only retry tasks of the write, and a job
    that fails leaves the old table as it was.

    A table of the same columns without partitions is switched to the new
    folder; otherwise a table with the columns of ``df``, keeping its partition
    columns where ``df`` still has them, is created beside it and takes its name
    (``sources.rewrite``): at every moment the old or the new table can be
    opened. Files are rebalanced, or laid out by ``sort_by``, or written as the rows
    come (None: what makes them is shared out well, or has them in their places).
    ``finish`` makes the table's rows of those laid out, each for itself (say,
    explodes them), so that what it adds is not shuffled. ``vacuum_table`` deletes
    superseded folders.
    """
    from trendlens.plans.tables import layout, with_filters
    name = f"{table.replace('.', '_')}-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}" if root else shared_path(spark, "trendlens-tables", name)
    recover(spark, table)
    exists = spark.catalog.tableExists(table)
    df = layout(df, sort_by, sort_by or ())
    df = finish(df) if finish else df
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition] if exists else []
    parts = [p for p in parts if p in df.columns]
    if parts:  # partition columns come last in a table
        df = df.select(*(f"`{c}`" for c in df.columns if c not in parts), *(f"`{p}`" for p in parts))
    writer = with_filters(df.write.mode("errorifexists"), df)
    with shuffles_dropped(spark):
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
    columns = lambda d: [(f.name, f.dataType) for f in d.schema.fields]
    place = path.replace("'", "\\'")
    if exists and not parts and not any(c.isPartition for c in spark.catalog.listColumns(table)) \
            and columns(spark.table(table)) == columns(df):
        spark.sql(f"ALTER TABLE {quoted(table)} SET LOCATION '{place}'")
    else:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        by = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
        switch_table(spark, table, f"({fields}) USING parquet{by} LOCATION '{place}'")
        if parts:
            spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def append_rows(spark: SparkSession, rows: DataFrame, table: str) -> None:
    """Add rows (with the table's columns) to a catalog table without rewriting it."""
    rows.select(*(f"`{c}`" for c in spark.table(table).columns)).write.insertInto(table)


def vacuum_table(spark: SparkSession, table: str) -> int:
    """Delete the folders that ``replace_table`` has left beside the table's present one, and the files that edits
    have left in it; how many folders.

    Frames that still read an older state of the table fail afterwards.
    """
    recover(spark, table)
    folder, own = location(spark, table).rsplit("/", 1)
    inside, beside = Files(spark, f"{folder}/{own}"), Files(spark, folder)
    made = re.compile(re.escape(table.replace(".", "_")) + "-[0-9a-f]{32}")
    gone = sum(inside.delete(n) for n in inside.names("_old-*"))
    if made.fullmatch(own):
        gone += sum(beside.delete(n) for n in beside.names("*") if made.fullmatch(n) and n != own)
    return gone


def save_table(df: DataFrame, path: str, cluster_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (),
               mode: str = "errorifexists", finish: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Write ``df`` as Parquet at ``path``, laid out as ``plans.tables.layout`` says; ``finish`` as in ``replace_table``."""
    from trendlens.plans.tables import layout, with_filters
    rows = layout(df, cluster_by, sort_by)
    rows = finish(rows) if finish else rows
    with_filters(rows.write.mode(mode), rows).parquet(path)
    return path
