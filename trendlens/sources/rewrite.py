"""Changing some files of a Parquet table, and switching to a new table, without a moment in which data can be lost.

``rewrite_files`` replaces the files that hold rows to be changed and leaves the others alone:

1. the new rows go to a folder that readers do not see (its name begins with ``_``);
2. a marker names the files that leave and those that come: from here on the edit holds;
3. the files are renamed, and the marker is deleted.

A job that fails before the marker stands leaves the old table; one that fails later is
finished by ``recover``, which every opening of the table through ``open_table`` calls.
Files that left stay in a folder ``_old-..`` until ``vacuum_table``, for queries that still read them.

A table of other columns is created beside the old one first (``<name>__next``), then names are
switched (``<name>__old``); ``recover`` finishes or undoes that from the names that exist.

One writer at a time is assumed, as everywhere in this library.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEXT, OLD = "__next", "__old"


def quoted(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def location(spark: SparkSession, table: str) -> str:
    row = spark.sql(f"DESCRIBE FORMATTED {quoted(table)}").where("col_name = 'Location'").first()
    return unquote(row["data_type"]).rstrip("/")


class Files:
    """The file system of a folder, through Spark's Hadoop classes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = folder
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def names(self, pattern: str) -> list[str]:
        found = self.fs.globStatus(self.path(pattern))
        return sorted(f.getPath().getName() for f in found or [])

    def below(self, name: str) -> list[str]:
        """Data files below a sub-folder, relative to it."""
        base, out = self.fs.makeQualified(self.path(name)).toString(), []
        files = self.fs.listFiles(self.path(name), True)
        while files.hasNext():
            own = files.next().getPath()
            if not own.getName().startswith(("_", ".")):
                out.append(own.toString()[len(base) + 1:])
        return out

    def move(self, source: str, target: str) -> None:
        """Does nothing where an earlier try has moved the file."""
        if not self.fs.exists(self.path(source)):
            return
        self.fs.mkdirs(self.path(target).getParent())
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"cannot rename {source} to {target} in {self.folder}")

    def write(self, name: str, text: str) -> None:
        """The whole file or none."""
        out = self.fs.create(self.path(f"_writing-{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(f"_writing-{name}", name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


def files_with(df: DataFrame, where: Column) -> dict[str, int]:
    """Rows for which ``where`` holds per file that has some: one row per such file reaches the driver."""
    rows = df.where(where).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return {unquote(r["file"]): r["n"] for r in rows.collect()}


def read_files(spark: SparkSession, table: str, files: list[str]) -> DataFrame:
    """The rows of some of a table's files."""
    return (spark.read.schema(spark.table(table).schema).option("basePath", location(spark, table)).parquet(*files)
            .select(*(f"`{c}`" for c in spark.table(table).columns)))


def _relative(names: list[str], folder: str) -> list[str] | None:
    """Paths below ``folder``, or None if some file lies elsewhere."""
    strip = lambda p: re.sub("/+", "/", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", p))
    base = strip(folder).rstrip("/") + "/"
    out = [strip(n) for n in names]
    return [n[len(base):] for n in out] if all(n.startswith(base) for n in out) else None


def rewrite_files(spark: SparkSession, table: str, files: list[str], rows: DataFrame) -> bool:
    """Replace ``files`` of ``table`` by files holding ``rows``; False if they do not lie below the table's folder."""
    folder = location(spark, table)
    left = _relative(files, folder)
    if left is None:
        return False
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    from trendlens.plans.tables import with_filters
    writer = with_filters(rows.select(*(f"`{c}`" for c in spark.table(table).columns)).write, rows)
    edit_folder(Files(spark, folder), left, (writer.partitionBy(*parts) if parts else writer).parquet)
    if parts:
        spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)
    return True


def edit_folder(store: Files, left: list[str], write: Callable[[str], None]) -> None:
    """Replace the files ``left`` of a folder by those that ``write`` puts in the folder it is given."""
    name = f"_edit-{uuid.uuid4().hex}"
    write(f"{store.folder}/{name}")
    store.write(f"{name}.json", json.dumps({"old": left, "new": store.below(name)}))
    _finish(store, f"{name}.json")


def finish_edits(store: Files) -> bool:
    """Finish the edits of a folder that a failed job has begun; whether there was one."""
    markers = store.names("_edit-*.json")
    for marker in markers:
        _finish(store, marker)
    return bool(markers)


def _finish(store: Files, marker: str) -> None:
    """The renames of an edit, from wherever an earlier try has stopped."""
    edit, change = marker.removesuffix(".json"), json.loads(store.read(marker))
    for name in change["old"]:
        store.move(name, f"_old-{edit.removeprefix('_edit-')}/{name}")
    for name in change["new"]:
        store.move(f"{edit}/{name}", name)
    store.delete(edit)
    store.delete(marker)


def recover(spark: SparkSession, table: str) -> bool:
    """Finish what a failed job has begun on ``table``; whether there was something."""
    exists = spark.catalog.tableExists
    done = False
    if not exists(table) and exists(table + NEXT):
        spark.sql(f"ALTER TABLE {quoted(table + NEXT)} RENAME TO {quoted(table)}")
        done = True
    if not exists(table):
        return done
    for rest in (table + OLD, table + NEXT):
        if exists(rest):
            spark.sql(f"DROP TABLE {quoted(rest)}")
            done = True
    store = Files(spark, location(spark, table))
    done = finish_edits(store) or done
    if done:
        if any(c.isPartition for c in spark.catalog.listColumns(table)):
            spark.catalog.recoverPartitions(table)
        spark.catalog.refreshTable(table)
    return done


def open_table(spark: SparkSession, table: str) -> DataFrame:
    """The table, with unfinished edits of it finished."""
    recover(spark, table)
    return spark.table(table)


def switch_table(spark: SparkSession, table: str, definition: str) -> None:
    """Put a new table (what follows its name in CREATE TABLE) in the place of ``table``."""
    recover(spark, table)
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {quoted(table)} {definition}")
        return
    spark.sql(f"CREATE TABLE {quoted(table + NEXT)} {definition}")
    spark.sql(f"ALTER TABLE {quoted(table)} RENAME TO {quoted(table + OLD)}")
    spark.sql(f"ALTER TABLE {quoted(table + NEXT)} RENAME TO {quoted(table)}")
    spark.sql(f"DROP TABLE {quoted(table + OLD)}")
