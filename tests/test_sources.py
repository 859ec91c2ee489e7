"""Sources and sinks: CSV round trip, table modes, map files, streaming."""

import json
import os

from pyspark.sql import functions as F

from trendlens.operators import country_names
from trendlens.plans.cleaning import RAW_COLUMNS, clean_trending
from trendlens.sources import atlas_country_names, ingest_csv, read_csv, replace_table, write_csv, write_names
from trendlens.streaming import stream_clean_snapshots


def _write_text(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_quoted_newlines_and_quotes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "in.csv")
    _write_text(path, 'video_id,video_title,video_view_count\n'
                      'a,"line one\nline two",12\n'
                      'b,"say ""hi""",1.5e3\n'
                      'c,,\n')
    df = read_csv(spark, path)
    rows = {r.video_id: (r.video_title, r.video_view_count) for r in df.collect()}
    assert rows == {"a": ("line one\nline two", "12"), "b": ('say "hi"', "1.5e3"), "c": (None, None)}
    assert all(t == "string" for _, t in df.dtypes)
    inferred = read_csv(spark, path, infer=True)
    assert dict(inferred.dtypes)["video_id"] == "string"


def test_ingest_replace_modes(spark, tmp_dir):
    p1, p2 = os.path.join(tmp_dir, "one.csv"), os.path.join(tmp_dir, "two.csv")
    _write_text(p1, "video_id\nx\n")
    _write_text(p2, "video_id\ny\nz\n")
    assert ingest_csv(spark, p1, "yt_raw_modes", replace=True).count() == 1
    assert ingest_csv(spark, p2, "yt_raw_modes").count() == 1          # exists: left as is
    assert ingest_csv(spark, p2, "yt_raw_modes", replace=True).count() == 2


def test_replace_takes_the_new_schema(spark, tmp_dir):
    p1, p2 = os.path.join(tmp_dir, "one.csv"), os.path.join(tmp_dir, "two.csv")
    _write_text(p1, "id,x\n1,a\n")
    _write_text(p2, "id,y,z\n2,b,c\n")
    ingest_csv(spark, p1, "yt_new_schema", replace=True)
    table = ingest_csv(spark, p2, "yt_new_schema", replace=True)
    assert [r.asDict() for r in table.collect()] == [{"id": "2", "y": "b", "z": "c"}]


def test_replace_keeps_partitions(spark):
    rows = [(1, "a", 7), (2, "b", 7), (3, "c", 8)]
    spark.createDataFrame(rows, "n int, s string, p int").write.mode("overwrite").partitionBy("p").saveAsTable("parted")
    replace_table(spark, spark.table("parted").where("n > 1"), "parted")
    assert sorted(map(tuple, spark.table("parted").collect())) == [(2, "b", 7), (3, "c", 8)]
    assert [c.name for c in spark.catalog.listColumns("parted") if c.isPartition] == ["p"]


def test_vacuum_deletes_superseded_folders(spark):
    from trendlens.sources import vacuum_table
    for n in (1, 2, 3):
        replace_table(spark, spark.range(n), "vacuumed")
    assert vacuum_table(spark, "vacuumed") == 2 and vacuum_table(spark, "vacuumed") == 0
    assert spark.table("vacuumed").count() == 3


def test_csv_is_read_in_splits(spark, tmp_dir):
    plain, quoted = os.path.join(tmp_dir, "plain.csv"), os.path.join(tmp_dir, "quoted.csv")
    line = "x" * 90
    body = [f'{i},"{line}, {i}"' for i in range(12000)]
    _write_text(plain, "id,text\n" + "\n".join(body) + "\n")
    body[5000] = f'5000,"{line}\n, 5000"'
    _write_text(quoted, "id,text\n" + "\n".join(body) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        lines, records = read_csv(spark, plain), read_csv(spark, quoted)
        assert lines.rdd.getNumPartitions() > 3 and records.rdd.getNumPartitions() > 3
        assert lines.count() == records.count() == 12000
        assert records.where("id = 5000").first().text == f"{line}\n, 5000"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_write_csv_round_trip_keeps_blanks(spark, tmp_dir):
    df = spark.createDataFrame([(" 12.7 ", "", None, 'a,"b"\nc')], "a string, b string, c string, d string")
    back = read_csv(spark, write_csv(df, os.path.join(tmp_dir, "out"))).first()
    # blanks survive; an empty text reads back as NULL, as a SQL CSV reader does
    assert tuple(back) == (" 12.7 ", None, None, 'a,"b"\nc')


def test_replace_table_from_itself(spark):
    spark.createDataFrame([(1,), (2,), (3,)], "n int").write.mode("overwrite").saveAsTable("edit_me")
    t = spark.table("edit_me")
    replace_table(spark, t.where("n <> 2").withColumn("n", F.col("n") * 10), "edit_me")
    assert sorted(r.n for r in spark.table("edit_me").collect()) == [10, 30]


def test_atlas_names_and_text_sink(spark, tmp_dir):
    path = os.path.join(tmp_dir, "atlas.json")
    doc = {"type": "Topology", "objects": {"countries": {"geometries": [
        {"properties": {"name": "France"}}, {"properties": {"name": "  Chad "}}, {"properties": {"name": ""}},
        {"properties": {"name": "France"}}, {"properties": {}}, {"id": 7}, {"properties": {"name": "   "}}]}}}
    _write_text(path, json.dumps(doc, indent=2))
    names = atlas_country_names(spark, path)
    assert [r.name for r in names.collect()] == ["", "Chad", "France"]
    out = write_names(names, os.path.join(tmp_dir, "names"))
    lines = spark.read.text(out).collect()
    assert sorted(r.value for r in lines) == ["", "Chad", "France"]


def test_atlas_without_countries(spark, tmp_dir):
    path = os.path.join(tmp_dir, "other.json")
    _write_text(path, json.dumps({"objects": {"land": {"geometries": []}}}))
    assert country_names(spark.read.option("multiLine", True).json(path)).count() == 0


def test_streaming_ingest_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    header = ",".join(RAW_COLUMNS)
    def row(vid, day, dur):
        vals = {c: "" for c in RAW_COLUMNS}
        vals.update(video_id=vid, video_view_count="1,234" if vid == "b" else "12.5",
                    video_trending__date=day, video_duration=dur, video_published_at="5/3/2024 7:05")
        return ",".join(f'"{vals[c]}"' for c in RAW_COLUMNS)
    _write_text(os.path.join(src, "day1.csv"), header + "\n" + row("a", "Mardi 5 août 2024", "PT1M30S") + "\n")
    _write_text(os.path.join(src, "day2.csv"), header + "\n" + row("b", "Mercredi 6 août 2024", "1:02:03") + "\n")
    out, ckpt = os.path.join(tmp_dir, "clean"), os.path.join(tmp_dir, "ckpt")
    stream_clean_snapshots(spark, src, out, ckpt).awaitTermination()
    got = spark.read.parquet(out).orderBy("video_id").collect()
    batch = clean_trending(read_csv(spark, src)).orderBy("video_id").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in batch]
    assert [(r.video_view_count, str(r.video_trending_date), r.video_duration_seconds) for r in got] == \
        [(13, "2024-08-05", 90), (None, "2024-08-06", 3723)]
    # a third file arrives: only it is processed on the next run
    _write_text(os.path.join(src, "day3.csv"), header + "\n" + row("c", "Jeudi 7 août 2024", "PT2H") + "\n")
    stream_clean_snapshots(spark, src, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    # restarts with nothing new (as after a crash) add nothing: the file sink
    # and checkpoint make the output exactly-once
    for _ in range(2):
        stream_clean_snapshots(spark, src, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_fallback_to_raw_table(spark):
    from trendlens.operators import counts_or_raw, flows_or_raw
    raw = spark.createDataFrame([("v", "FR", "ES", "1,5"), ("v", "FR", "ES", "7"), ("w", "FR", "ES", None)],
                                "video_id string, channel_country string, video_trending_country string, "
                                "video_view_count string")
    raw.write.mode("overwrite").saveAsTable("raw_only_src")
    import pytest
    for refused in ({"mode": "international"}, {"on_date": "2024-01-01"}, {"sources": "DE"}):
        with pytest.raises(ValueError):
            flows_or_raw(spark, clean="no_such_clean", raw="raw_only_src", **refused)
    with pytest.raises(ValueError):
        counts_or_raw(spark, "no_such_clean", "raw_only_src", on_date="2024-13-45", unfiltered=True)
    got = flows_or_raw(spark, clean="no_such_clean", raw="raw_only_src", mode="international", unfiltered=True).collect()
    assert [(r.src, r.dst, r.cnt, r.views) for r in got] == [("FR", "ES", 2, 22)]
    assert {r.country: r.cnt for r in counts_or_raw(spark, "no_such_clean", "raw_only_src").collect()} == {"ES": 2}


def test_streaming_refuses_reordered_header(spark, tmp_dir):
    import pytest
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    cols = list(RAW_COLUMNS)
    cols[0], cols[1] = cols[1], cols[0]
    _write_text(os.path.join(src, "bad.csv"), ",".join(cols) + "\n" + ",".join(["x"] * len(cols)) + "\n")
    q = stream_clean_snapshots(spark, src, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    with pytest.raises(Exception):
        q.awaitTermination()


def test_build_tables_end_to_end(spark, tmp_dir):
    from trendlens import operators as ops
    from trendlens.plans.etl import build_tables
    header = ",".join(RAW_COLUMNS)

    def row(vid, src, dst, day, views, tags):
        vals = {c: "" for c in RAW_COLUMNS}
        vals.update(video_id=vid, channel_country=src, video_trending_country=dst, video_trending__date=day,
                    video_view_count=views, video_tags=tags, video_duration="PT1M30S")
        return ",".join(f'"{vals[c]}"' for c in RAW_COLUMNS)
    path = os.path.join(tmp_dir, "export.csv")
    _write_text(path, "\n".join([header, row("a", "FR", "ES", "Mardi 5 août 2024", "1,234", "Foot, Sport"),
                                 row("a", "FR", "ES", "Mercredi 6 août 2024", "2000", "foot"),
                                 row("b", "ES", "ES", "Mardi 5 août 2024", "7", "sport,x")]) + "\n")
    clean, tags = build_tables(spark, path, os.path.join(tmp_dir, "clean"), os.path.join(tmp_dir, "tags"))
    assert clean.count() == 3 and tags.count() == 4  # "x" is one character: dropped
    flows = ops.country_flows(clean, mode="international").collect()
    assert [(r.src, r.dst, r.cnt, r.views) for r in flows] == [("FR", "ES", 1, 2000)]
    assert {r.tag: r.tag_count for r in ops.top_tags(tags, clean, mode="all", min_count=1).collect()} == \
        {"foot": 2, "sport": 2}
