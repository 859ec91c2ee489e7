"""Session construction and the shared folder for written intermediates."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every entry point relies on. UTC keeps timestamp parsing stable;
# ANSI stays on (the 4.x default), which is why dirty text goes through try_*.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Fall back from whole-stage codegen for a subtree whose generated method
    # exceeds what the JIT compiles (8000 bytecodes) instead of running it
    # interpreted; measured equal or faster on every registered query.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Size estimates of Parquet scans start from the compressed file size;
    # text columns decode to several times that, and an underestimate makes
    # the planner broadcast a side that is not small (measured: the tag join
    # broadcast 600k rows and ran 1.7x slower than shuffled).
    "spark.sql.sources.fileCompressionFactor": "4",
    # Many distinct queries against the same tables (a dashboard): keep
    # their generated code cached instead of recompiling (default 100).
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "trendlens", shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster, pass master=None and let spark-submit decide; shuffle
    partitions default to Spark's own value unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when neither is set and the master is local -- a bare test session -- is
    a private folder created and registered, so that
    ``DataFrame.checkpoint()`` works too. On a cluster a machine-local folder
    would lose data with its executor, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster[..] has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf_dir = tempfile.mkdtemp(prefix="trendlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder (URI-safe join)."""
    base = shared_dir(spark).rstrip("/")
    return "/".join([base, *[p.strip("/") for p in parts]])


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is run inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files: they go when a write has ended, not when the driver collects garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def file_by_file(spark: SparkSession):
    """What is read inside has a task for each file (for each piece of a large one), so rows keep their places in files."""
    return settings(spark, {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes")})


def send_package(spark: SparkSession) -> None:
    """This package as a zip on all executors, once per application, for functions that run in Python tasks."""
    context = spark.sparkContext
    if getattr(context, "_trendlens_sent", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # else it came as a zip or is installed
        folder = tempfile.mkdtemp(prefix="trendlens-package-")
        os.makedirs(f"{folder}/tree")
        shutil.copytree(package, f"{folder}/tree/{os.path.basename(package)}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/trendlens-tasks", "zip", f"{folder}/tree"))
    context._trendlens_sent = True
