"""Daily snapshot files arriving over time -> clean table, incrementally.

The batch path reads a CSV export and cleans it (``read_csv`` then
``clean_trending``). When a new snapshot file lands every day, the same
cleaning runs as a Structured Streaming query over the folder: each new file
is read once, cleaned, and appended to the clean Parquet table. The file
sink and the checkpoint give exactly-once output across restarts and lost
executors; ``available_now`` processes what is there and stops (a daily
job), otherwise it keeps polling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trendlens.operators.filters import with_keys
from trendlens.plans.cleaning import RAW_COLUMNS, clean_trending
from trendlens.plans.tables import DAY, layout, with_filters
from trendlens.session import shared_path, shuffles_dropped
from trendlens.sources.rewrite import Files, edit_folder, finish_edits

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])


def _raw(spark: SparkSession, source_dir: str, sep: str, max_files_per_trigger: int | None, multiline: bool) -> DataFrame:
    # enforceSchema=false: the header of every file is checked against the
    # schema, so a file with columns in another order fails loudly instead
    # of being read by position into the wrong columns.
    reader = (spark.readStream.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", False)
              .option("sep", sep).option("multiLine", multiline).option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.csv(source_dir)


def stream_clean_snapshots(spark: SparkSession, source_dir: str, target_dir: str,
                           checkpoint_dir: str | None = None, sep: str = ",", available_now: bool = True,
                           max_files_per_trigger: int | None = None, multiline: bool = True) -> StreamingQuery:
    """Start the incremental cleaning of CSV snapshots in ``source_dir``
    into Parquet at ``target_dir``. Returns the running query.

    Records may hold newlines, so a file is read by one task; where they
    never do, ``multiline=False`` lets large files be split.
    """
    clean = clean_trending(_raw(spark, source_dir, sep, max_files_per_trigger, multiline))
    ckpt = checkpoint_dir or shared_path(spark, "trendlens-streams", target_dir.strip("/").replace("/", "_"))
    writer = (clean.writeStream.format("parquet").option("path", target_dir)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def stream_clean_table(spark: SparkSession, source_dir: str, target_dir: str, checkpoint_dir: str | None = None,
                       sep: str = ",", available_now: bool = True, max_files_per_trigger: int | None = None,
                       multiline: bool = True) -> StreamingQuery:
    """Like ``stream_clean_snapshots``, into a table with key columns and the layout of ``build_tables``.

    Each batch is laid out in ranges of (day, video) and its files carry its number, so a batch that is run
    again after a failure replaces its own files. ``compact_snapshots`` merges older batches.

    A file is parsed by one task, so the text of a batch of few files is dealt to all cores before it is cleaned.
    """
    raw = _raw(spark, source_dir, sep, max_files_per_trigger, multiline)
    ckpt = checkpoint_dir or shared_path(spark, "trendlens-streams", target_dir.strip("/").replace("/", "_"))
    def put(batch: DataFrame, number: int) -> None:
        replace_batch(with_keys(clean_trending(dealt(batch))), number, target_dir)

    writer = raw.writeStream.foreachBatch(put).option("checkpointLocation", ckpt).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over all cores, if fewer tasks make them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def replace_batch(batch: DataFrame, number: int, target_dir: str) -> None:
    """Put a batch's rows in the table, in the place of what an earlier try of the same batch has put there.

    The rows are written as they come before they are laid out: finding the ranges reads them once more, and the
    files of the batch are parsed and cleaned once only.
    """
    spark = batch.sparkSession
    store, name = Files(spark, target_dir.rstrip("/")), f"batch-{number:012d}"
    finish_edits(store)
    with shuffles_dropped(spark):
        batch.write.mode("overwrite").parquet(f"{store.folder}/_rows-{name}")
        rows = spark.read.schema(batch.schema).parquet(f"{store.folder}/_rows-{name}")
        with_filters(layout(rows, (DAY,), (DAY, "video_id")).write.mode("overwrite"), rows).parquet(f"{store.folder}/_{name}")
    store.delete(f"_rows-{name}")
    for old in store.names(f"{name}-*"):
        store.delete(old)
    for new in store.below(f"_{name}"):
        store.move(f"_{name}/{new}", f"{name}-{new}")
    store.delete(f"_{name}")


def compact_snapshots(spark: SparkSession, target_dir: str) -> int:
    """Merge the files of all batches but the newest (which may be run again) into one layout; how many there were."""
    store = Files(spark, target_dir.rstrip("/"))
    finish_edits(store)
    batches = store.names("batch-*.parquet")
    newest = max((n.split("-")[1] for n in batches), default="")
    old = [n for n in batches if n.split("-")[1] != newest]
    if not old:
        return 0
    old += store.names("part-*.parquet")
    rows = spark.read.parquet(*(f"{store.folder}/{n}" for n in old))
    with shuffles_dropped(spark):
        edit_folder(store, old, lambda path: with_filters(layout(rows, (DAY,), (DAY, "video_id")).write, rows).parquet(path))
    return len(old)
