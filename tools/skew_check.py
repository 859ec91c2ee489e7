"""Measure what a hot key does to the biggest task.

    python tools/skew_check.py [sf_dir]

The clean stand-in is rewritten so that about a third of its rows belong to
one video, one country pair and one day. Each operator then runs with
Spark's event log written to a scratch folder, and for every stage that
reads shuffle data the largest number of records read by one task is
reported, as a share of the input rows. Without map-side reduction the hot
key would put a third of the input into one task.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from trendlens import operators as ops  # noqa: E402
from trendlens.plans import standins as st  # noqa: E402
from trendlens.plans.tables import DAY, layout  # noqa: E402


def hot_table(spark, sf_dir: str, path: str):
    t = st.trending(spark, sf_dir)
    hot = F.pmod(F.xxhash64("video_id", "channel_title", "video_view_count"), F.lit(3)) == 0
    t = t.select(
        F.when(hot, F.lit("HOT")).otherwise(F.col("video_id")).alias("video_id"), "video_title", "channel_title",
        F.when(hot, F.lit("NATION_1")).otherwise(F.col("channel_country")).alias("channel_country"),
        F.when(hot, F.lit("NATION_2")).otherwise(F.col("video_trending_country")).alias("video_trending_country"),
        F.when(hot, F.lit("1996-03-15").cast("date")).otherwise(F.col("video_trending_date"))
        .alias("video_trending_date"),
        "video_view_count", "video_like_count", "video_comment_count", "video_tags")
    t.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


QUERIES = {
    "country_counts": lambda t: ops.country_counts(t),
    "country_flows": lambda t: ops.country_flows(t, mode="international"),
    "country_flows_raw": lambda t: ops.country_flows_raw(t),
    "top_videos": lambda t: ops.top_videos(t, mode="all"),
    "views_timeline_all": lambda t: ops.views_timeline(t, mode="all"),
    "top_tags": lambda t: ops.top_tags(None, t, mode="all"),
    "clean_table_write (ranges of day, video, row)": lambda t: layout(t, (DAY,), (DAY, "video_id")),
    # Contrast, not an operator of this library: a window over each whole
    # video with no top-1 cut sends every row of the hot video to one task.
    "naive_full_window (contrast)": lambda t: t.withColumn(
        "rn", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("video_view_count")))),
}


def stage_reads(log_dir: str) -> dict[int, list[int]]:
    reads: dict[int, list[int]] = {}
    for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(f) or os.path.basename(f).startswith("."):
            continue
        with open(f, encoding="utf-8") as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                n = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                if n:
                    reads.setdefault(ev["Stage ID"], []).append(n)
    return reads


def _session(name: str, extra: dict[str, str]) -> SparkSession:
    b = (SparkSession.builder.master("local[8]").appName(name).config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    scratch = tempfile.mkdtemp(prefix="trendlens-skew-")
    path = os.path.join(scratch, "hot")
    spark = _session("skew-data", {})
    table = hot_table(spark, sf_dir, path)
    n_rows, n_hot = table.count(), table.where("video_id = 'HOT'").count()
    spark.stop()
    results = {}
    for name, build in QUERIES.items():
        log_dir = os.path.join(scratch, f"log-{name}")
        os.makedirs(log_dir)
        # Coalescing off: with this little data AQE would merge every reduce
        # partition into one task, which says nothing about skew.
        conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        spark = _session(f"skew-{name}", conf)
        build(spark.read.parquet(path)).write.format("noop").mode("overwrite").save()
        spark.stop()
        reads = stage_reads(log_dir)
        biggest = max((max(v) for v in reads.values()), default=0)
        results[name] = {"input_rows": n_rows, "hot_rows": n_hot, "max_task_shuffle_records": biggest,
                         "max_task_share": round(biggest / n_rows, 4)}
        print(json.dumps({name: results[name]}), flush=True)
    return results


if __name__ == "__main__":
    main(sys.argv)
