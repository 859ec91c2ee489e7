"""The streamed table: laid out, exactly once, compacted."""

import contextlib
import io
import os

import pyarrow.parquet as pq
import pytest

from trendlens.operators.filters import with_keys
from trendlens.plans.cleaning import RAW_COLUMNS, clean_trending
from trendlens.sources import read_csv, rewrite
from trendlens.streaming import compact_snapshots, replace_batch, stream_clean_table

DAYS = ["Lundi 5 août 2024", "Mardi 6 août 2024", "Mercredi 7 août 2024"]


def snapshot(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(",".join(RAW_COLUMNS) + "\n")
        for video, day in rows:
            values = dict.fromkeys(RAW_COLUMNS, "") | {"video_id": video, "channel_country": "FR", "video_trending__date": day,
                                                       "video_view_count": "12", "video_duration": "PT1M30S"}
            f.write(",".join(f'"{values[c]}"' for c in RAW_COLUMNS) + "\n")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_streamed_table_is_laid_out_and_exactly_once(spark, tmp_dir):
    src, out, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "out", "ckpt"))
    for k in range(4):
        snapshot(src, f"day{k}.csv", [(f"V{i}", DAYS[(i + k) % 3]) for i in range(50)])
    run = lambda: stream_clean_table(spark, src, out, ckpt, max_files_per_trigger=1).awaitTermination()
    run()
    want = lambda: rows_of(with_keys(clean_trending(read_csv(spark, src))))
    assert rows_of(spark.read.parquet(out)) == want()
    run()  # nothing new
    assert rows_of(spark.read.parquet(out)) == want()
    assert compact_snapshots(spark, out) > 0
    assert rows_of(spark.read.parquet(out)) == want()
    snapshot(src, "day9.csv", [("later", DAYS[0])])
    run()
    assert rows_of(spark.read.parquet(out)) == want()
    assert compact_snapshots(spark, out) > 0 and rows_of(spark.read.parquet(out)) == want()
    # Days and keys prune: every file is sorted by day, and its statistics tell which it holds.
    files = [f for f in os.listdir(out) if f.endswith(".parquet")]
    for f in files:
        days = pq.read_table(os.path.join(out, f)).column("video_trending_date").to_pylist()
        assert days == sorted(days)
    plan = spark.read.parquet(out).where("video_key = 'v7' AND video_trending_date = DATE'2024-08-06'")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        plan.explain("formatted")
    assert "EqualTo(video_key,v7)" in shown.getvalue() and "EqualTo(video_trending_date,2024-08-06)" in shown.getvalue()


@pytest.mark.parametrize("stop", ["move", "delete"])
def test_a_batch_run_again_replaces_its_files(spark, tmp_dir, monkeypatch, stop):
    rows = spark.createDataFrame([(f"V{i}", None) for i in range(40)], "video_id string, video_trending_date date")
    replace_batch(rows.limit(3), 0, tmp_dir)
    real = getattr(rewrite.Files, stop)
    monkeypatch.setattr(rewrite.Files, stop, lambda *_: (_ for _ in ()).throw(OSError("injected")))
    with pytest.raises(OSError, match="injected"):
        replace_batch(rows, 1, tmp_dir)
    monkeypatch.setattr(rewrite.Files, stop, real)
    for _ in range(2):
        replace_batch(rows, 1, tmp_dir)
        assert spark.read.parquet(tmp_dir).count() == 43


def test_an_unfinished_compaction_is_finished(spark, tmp_dir, monkeypatch):
    for k in range(3):
        replace_batch(spark.createDataFrame([(f"V{k}", None)], "video_id string, video_trending_date date"), k, tmp_dir)
    real = rewrite.Files.delete
    monkeypatch.setattr(rewrite.Files, "delete", lambda *_: (_ for _ in ()).throw(OSError("injected")))
    with pytest.raises(OSError, match="injected"):
        compact_snapshots(spark, tmp_dir)
    monkeypatch.setattr(rewrite.Files, "delete", real)
    assert compact_snapshots(spark, tmp_dir) == 0
    assert sorted(r.video_id for r in spark.read.parquet(tmp_dir).collect()) == ["V0", "V1", "V2"]
