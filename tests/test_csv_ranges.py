"""CSV in splits: equal to the one-task reader whatever the quoting, and types by all cells."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import types as T

from trendlens.sources import csv_ranges, read_csv
from trendlens.sources.csv_ranges import BETWEEN, INSIDE, line_end
from trendlens.sources.infer import cell_types

FIELDS = ['plain', '', '"quoted"', '"a, b"', '"say ""hi"""', '"two\nlines"', '"three\n\nlines, ""x""\n"', '5" screen',
          'x"y"z', '""', '"stray"tail', '"q" ', '" "', '"\n"', "é€", '"""', 'tail"', '"a""b\nc"']


def one_task(spark, path):
    """The same files parsed whole, in the same file order."""
    return read_csv(spark, path, multiline=True)


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture()
def small_splits(spark):
    """Splits of some hundred bytes."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    for k, v in saved.items():
        spark.conf.set(k, v)


def write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return os.path.join(folder, name)


def random_csv(seed, n=60, fields=FIELDS, eol="\n"):
    rng = random.Random(seed)
    lines = ["id,a,b,c"] + [",".join([str(i), *rng.choices(fields, k=3)]) for i in range(n)]
    return eol.join(lines) + rng.choice(["", eol])


@pytest.mark.parametrize("seed,size", [(0, 40), (1, 40), (2, 300), (3, 300), (5, 90)])
def test_equal_to_one_task(spark, tmp_dir, small_splits, seed, size):
    fields = [f for f in FIELDS if f not in ('"""',)]  # a field that never closes takes the rest of its file
    for k in range(1 + seed % 3):
        write(tmp_dir, f"part{k}.csv", random_csv(10 * seed + k, fields=fields if seed % 2 else FIELDS[:8]))
    want = rows_of(one_task(spark, tmp_dir))
    small_splits(size)
    assert csv_ranges.split_records(spark, tmp_dir) is not None
    assert rows_of(read_csv(spark, tmp_dir)) == want


@pytest.mark.parametrize("body", [
    "1,a,b,c\n" * 50 + '2,"' + "line\n" * 200 + '",b,c\n' + "3,x,y,z\n" * 50,        # one field over many splits
    "1,a,b,c\n" * 100 + '2,"opens,here\n' + "3,x,y,z\n" * 100 + "4",                   # and never closes
    "".join(f'{i},"t\n{i}",b,c\n' for i in range(80)),
    "1,a,b,c\n" * 150 + '2,"x",b,c\n',                                                 # quotes in the last split only
    '0,"x\ny",b,c\n' + "1,a,b,c\n" * 150,                                              # or in the first
    "\n\n1,a,b,c\n\n" * 30 + '2,"\n\n",b,c\n',                                         # empty lines
])
@pytest.mark.parametrize("size", [50, 700])
def test_awkward_files(spark, tmp_dir, small_splits, body, size):
    path = write(tmp_dir, "in.csv", "id,a,b,c\n" + body)
    want = rows_of(one_task(spark, path))
    small_splits(size)
    assert rows_of(read_csv(spark, path)) == want


def test_windows_line_ends(spark, tmp_dir, small_splits):
    path = write(tmp_dir, "in.csv", random_csv(4, fields=FIELDS[:6], eol="\r\n"))
    want = rows_of(one_task(spark, path))
    small_splits(200)
    assert rows_of(read_csv(spark, path)) == want


def test_reading_is_spread_and_stops_at_boundaries(spark, tmp_dir, small_splits):
    line = "x" * 90
    path = write(tmp_dir, "in.csv", "id,text\n" + "".join(f'{i},"{line}\n, {i}"\n' for i in range(12000)))
    small_splits(128 << 10)
    df = read_csv(spark, path)
    assert df.rdd.getNumPartitions() > 3 and df.count() == 12000
    assert df.where("id = 5000").first().text == f"{line}\n, 5000"
    lines = csv_ranges._lines(spark, path)
    heads = lines.mapInArrow(csv_ranges._heads(",", None), csv_ranges._HEAD_TYPE).collect()
    assert sum(h.stopped for h in heads) == len(heads) - 1 and max(len(h.certain) for h in heads) <= 3


def test_a_shifted_cut_stops_the_job(spark, tmp_dir, small_splits):
    path = write(tmp_dir, "in.csv", random_csv(3, n=300, fields=FIELDS[:6]))
    small_splits(400)
    nothing_planned = spark.sparkContext.broadcast({})
    lines = csv_ranges._lines(spark, path).select("value", "file", "start")
    with pytest.raises(Exception, match="cut elsewhere"):
        lines.mapInArrow(csv_ranges._records(",", nothing_planned), "record string").collect()


def test_too_large_heads_are_read_whole(spark, tmp_dir, small_splits, monkeypatch):
    path = write(tmp_dir, "in.csv", random_csv(5, fields=FIELDS[:6]))
    want = rows_of(one_task(spark, path))
    small_splits(100)
    monkeypatch.setattr(csv_ranges, "HEADS_BYTES", 50)
    with pytest.raises(csv_ranges.HeadsTooLarge):
        csv_ranges.split_records(spark, path)
    assert rows_of(read_csv(spark, path)) == want


@pytest.mark.parametrize("line,between,inside", [
    ("a,b", BETWEEN, INSIDE), ('a,"b', INSIDE, BETWEEN), ('a,"b"', BETWEEN, BETWEEN), ('"a""', INSIDE, BETWEEN),
    ('5" x', BETWEEN, BETWEEN), ('x","', INSIDE, INSIDE), ('"a"b,"c', INSIDE, INSIDE), ("", BETWEEN, INSIDE),
    ('a"",b', BETWEEN, INSIDE), ('"a" ,b', BETWEEN, BETWEEN), ('""', BETWEEN, INSIDE),
])
def test_line_maps(line, between, inside):
    assert (line_end(line, BETWEEN, ","), line_end(line, INSIDE, ",")) == (between, inside)


def test_schema_is_checked_and_applied(spark, tmp_dir, small_splits):
    path = write(tmp_dir, "in.csv", 'id,t\n1,"a\nb"\n2,c\n')
    rows = read_csv(spark, path, schema="id int, t string").collect()
    assert [tuple(r) for r in rows] == [(1, "a\nb"), (2, "c")]
    with pytest.raises(ValueError):
        read_csv(spark, path, schema="t string, id int")


def test_types_by_all_cells(spark):
    cells = {"flag": ("boolean", ["true", "FALSE", None]), "whole": ("bigint", [" 12 ", "-7", "+3"]),
             "wide": ("double", ["9223372036854775808", "1", None]), "real": ("double", ["1.5", "2", ".5e3"]),
             "day": ("date", ["2024-02-29", "2023-1-5", None]), "moment": ("timestamp", ["2024-02-29", "2024-01-01 7:05", None]),
             "baad": ("string", ["2024-02-30", "2024-01-01", None]), "clock": ("string", ["01:02:03", "7:05", None]),
             "mixed": ("string", ["true", "1", None]), "none": ("string", [None, None, None]), "suffix": ("string", ["1d", "2f", None]),
             "a.b `c": ("bigint", ["1", "2", "3"])}
    rows = list(zip(*(v for _, v in cells.values())))
    df = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in cells]))
    assert cell_types(df) == {n: t for n, (t, _) in cells.items()}


def test_inferred_read(spark, tmp_dir):
    path = write(tmp_dir, "in.csv", 'id,ok,price,day,at,text\n1,true,2.5,2024-01-02,7:05,"a\nb"\n2,false,3,2024-01-03,8:00,\n')
    df = read_csv(spark, path, infer=True)
    assert dict(df.dtypes) == {"id": "bigint", "ok": "boolean", "price": "double", "day": "date", "at": "string", "text": "string"}
    assert df.orderBy("id").first() == (1, True, 2.5, dt.date(2024, 1, 2), "7:05", "a\nb")
