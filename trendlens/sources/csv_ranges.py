"""Reading CSV whose records may go on over lines in splits of the files.

A split may begin inside a quoted field, so a reader of it does not know where
its first record begins. What a line does to the quoting state is a map of two
states, *between records* and *inside a field*, and maps of lines compose. Most
lines with a quoted field end between records whatever state they began in: the
first such line of a split is a record boundary for certain.

1. *Heads.* Each split gives its lines up to that boundary. Reading stops there,
   so where quoted fields are common the files are not read once more. A split
   without such a boundary gives its map; if what precedes it was not read to its
   end, that file is read through, and maps are composed from its beginning on.
2. *Records.* The task of a split skips its head, joins the lines of each record,
   and goes on with the head of the next split, so every record is made once
   and whole. ``from_csv`` parses the records in the JVM.

Heads are some lines per split. They are broadcast if together they take at most
HEADS_BYTES; else the files are parsed whole, one task each. A split that the
second reading cuts elsewhere than the first stops the job instead of losing lines.

A field that is never closed goes on to the end of its file, as in the reader of whole
files, only without the file's last line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.session import send_package

HEADS_BYTES = 64 << 20   # heads of all splits, broadcast
HEAD_BYTES = 4 << 20     # lines searched for a split's boundary before it counts as without one

BETWEEN, INSIDE = 0, 1


@lru_cache(maxsize=None)
def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end between records, begun between records and begun inside a field.

    A field that begins with a quote ends at the next quote that is not doubled; what
    follows up to the separator belongs to it. Elsewhere a quote is an ordinary character.
    """
    other = f"[^{re.escape(sep)}]*+"
    rest = rf'(?:[^"]|"")*+"(?!"){other}'
    field = rf'(?:"{rest}|(?!"){other})'
    more = f"(?:{re.escape(sep)}{field})*+"
    return re.compile(field + more, re.DOTALL), re.compile(rest + more, re.DOTALL)


def line_end(line: str, state: int, sep: str) -> int:
    """The state behind ``line`` begun in ``state``."""
    if '"' not in line:
        return state
    return BETWEEN if _patterns(sep)[state].fullmatch(line) else INSIDE


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Runs of rows of one split."""
    for batch in batches:
        file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
        cuts = [0, *((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1, batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def _heads(sep: str, through: frozenset[int] | None):
    """One row per split: its map, and its lines up to the first boundary that holds for both states.

    Reading stops at that boundary in splits that the file goes on behind (they fill their task). With ``through``,
    only the splits of those files give a row, and are read to their end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, head, size, certain, quotes = None, [], [], 0, None, False

        def row(stopped: bool = False) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "file": now[0], "start": now[1], "from_between": ends[BETWEEN], "from_inside": ends[INSIDE],
                "certain": certain, "stopped": stopped, "quotes": quotes}], _HEAD_ROW)

        for split, part in _groups(batches):
            goes_on = split[1] + part.column("length")[0].as_py() < part.column("size")[0].as_py()
            if through is not None and split[0] not in through:
                if goes_on:
                    return
                continue
            if split != now:
                if now is not None:
                    yield row()
                now, ends, head, size, certain, quotes = split, [BETWEEN, INSIDE], [], 0, None, False
            values = part.column("value")
            quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False).nonzero()[0].tolist()
            quotes = quotes or bool(quoted)
            for i in quoted:
                line = values[i].as_py()
                ends = [line_end(line, state, sep) for state in ends]
                if certain is None and ends == [BETWEEN, BETWEEN] and size <= HEAD_BYTES:
                    certain = [*head, *values[: i + 1].to_pylist()]
                    if goes_on and through is None:
                        yield row(stopped=True)
                        return
            if certain is None and size <= HEAD_BYTES:
                head += values.to_pylist()
                size += values.nbytes
            else:
                head = []
        if now is not None:
            yield row()
    return run


def _insides(sep: str, wanted: set[tuple[int, int]]):
    """The lines up to the first boundary of splits that begin inside a field; all where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, closed = None, [], False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "lines": lines, "closed": closed}], _INSIDE_ROW)

        for split, part in _groups(batches):
            if split not in wanted:
                continue
            if split != now:
                if now is not None:
                    yield row()
                now, lines, closed = split, [], False
            for line in () if closed else part.column("value").to_pylist():
                lines.append(line)
                if line_end(line, INSIDE, sep) == BETWEEN:
                    closed = True
                    break
        if now is not None:
            yield row()
    return run


_HEAD_TYPE = ("file long, start long, from_between int, from_inside int, certain array<string>, stopped boolean, "
              "quotes boolean")
_HEAD_ROW = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("from_between", pa.int32()), ("from_inside", pa.int32()),
                       ("certain", pa.list_(pa.string())), ("stopped", pa.bool_()), ("quotes", pa.bool_())])
_INSIDE_TYPE = "file long, start long, lines array<string>, closed boolean"
_INSIDE_ROW = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("lines", pa.list_(pa.string())),
                         ("closed", pa.bool_())])


@dataclass(frozen=True)
class Part:
    """What the task of a split does beside its lines: how many to skip, and lines to go on with."""
    skip: int
    tail: tuple[str, ...]


def start_states(rows: list[dict]) -> tuple[dict, set[int]]:
    """State at the beginning of every split without a certain boundary, and the files that must be read through."""
    states, unclear = {}, set()
    end, file = None, None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        key = (r["file"], r["start"])
        if r["file"] != file:
            file, end = r["file"], BETWEEN
            states[key] = BETWEEN
        elif r["certain"] is None:
            states[key] = end
            if end is None:
                unclear.add(r["file"])
        ends = (r["from_between"], r["from_inside"])
        if r["stopped"]:
            end = None
        elif key in states and states[key] is not None:
            end = ends[states[key]]
        else:
            end = ends[0] if ends[0] == ends[1] else None
    return states, unclear


def plan_parts(rows: list[dict], states: dict, insides: dict) -> dict[tuple[int, int], Part]:
    """Parts of all splits: a split's head goes to the split before it that has records of its own."""
    parts: dict[tuple[int, int], Part] = {}
    behind: list[str] = []
    file = None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"]), reverse=True):
        key = (r["file"], r["start"])
        if r["file"] != file:
            file, behind = r["file"], []
        if key not in states:
            head, whole = r["certain"], False
        elif states[key] == BETWEEN:
            head, whole = [], False
        else:
            head, whole = insides[key][0], not insides[key][1]
        parts[key] = Part(len(head), () if whole else tuple(behind))
        behind = [*head, *behind] if whole else list(head)
    return parts


def _records(sep: str, planned):
    """Records of each split, the header of each file left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, skip, header, open_lines = None, None, 0, False, []

        def joined(values: pa.Array) -> list[pa.Array]:
            """Records that end in ``values``; lines of an open one are kept."""
            nonlocal open_lines
            out, done = [], 0
            for i in pc.match_substring(values, '"').to_numpy(zero_copy_only=False).nonzero()[0].tolist():
                line = values[i].as_py()
                if open_lines:
                    if line_end(line, INSIDE, sep) == BETWEEN:
                        out.append(pa.array(["\n".join([*open_lines, *values[done: i + 1].to_pylist()])]))
                        open_lines, done = [], i + 1
                elif line_end(line, BETWEEN, sep) == INSIDE:
                    out.append(values[done:i])
                    open_lines, done = [line], i + 1
            if open_lines:
                open_lines += values[done:].to_pylist()
            else:
                out.append(values[done:])
            return out

        def batch(records: list[pa.Array]) -> pa.RecordBatch:
            nonlocal header
            all_records = pa.concat_arrays(records) if records else pa.array([], pa.string())
            if header and len(all_records):
                all_records, header = all_records[1:], False
            return pa.RecordBatch.from_arrays([all_records], names=["record"])

        def finish() -> pa.RecordBatch:
            nonlocal open_lines
            records = joined(pa.array(part.tail, pa.string()))
            if open_lines:  # the file ends inside a field
                records.append(pa.array(["\n".join(open_lines)]))
                open_lines = []
            return batch(records)

        for split, rows in _groups(batches):
            if split != now:
                if now is not None:
                    yield finish()
                if split not in planned.value:
                    raise RuntimeError(f"files were cut elsewhere than before, at {split[1]}: read them again")
                now, part = split, planned.value[split]
                skip, header = part.skip, split[1] == 0
            values = rows.column("value")
            some = min(skip, len(values))
            skip -= some
            yield batch(joined(values[some:]))
        if now is not None:
            yield finish()
    return run


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their split. Where the first line ends with CR LF, a CR ends every line."""
    meta = lambda c: F.col(f"_metadata.{c}")
    text = spark.read.option("lineSep", "\n").text(path)
    first = text.select("value").first()
    value = F.col("value")
    if first is not None and first["value"].endswith("\r"):
        value = F.when(value.endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(value)
    return text.select(
        value.alias("value"), F.xxhash64(meta("file_path")).alias("file"), meta("file_block_start").alias("start"),
        meta("file_block_length").alias("length"), meta("file_size").alias("size"))


class HeadsTooLarge(Exception):
    """Heads of all splits take more than HEADS_BYTES."""


def split_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame | None:
    """(record) of the CSV files, headers left out, read in splits; None if no line holds a quote: lines are records."""
    send_package(spark)
    lines = _lines(spark, path)
    found = _fetched(spark, lines.mapInArrow(_heads(sep, None), _HEAD_TYPE))
    if not any(r["quotes"] for r in found):
        return None
    states, unclear = start_states(found)
    if unclear:
        again = _fetched(spark, lines.mapInArrow(_heads(sep, frozenset(unclear)), _HEAD_TYPE))
        found = [r for r in found if r["file"] not in unclear] + again
        states, _ = start_states(found)
    inside = frozenset(key for key, state in states.items() if state == INSIDE)
    insides = {}
    if inside:
        got = _fetched(spark, lines.mapInArrow(_insides(sep, inside), _INSIDE_TYPE))
        insides = {(r["file"], r["start"]): (r["lines"], r["closed"]) for r in got}
    planned = spark.sparkContext.broadcast(plan_parts(found, states, insides))
    return lines.select("value", "file", "start").mapInArrow(_records(sep, planned), "record string")


def _fetched(spark: SparkSession, rows: DataFrame) -> list[dict]:
    """Rows with a head each, if their bytes, counted where they are written, allow it."""
    from trendlens.plans.tables import write_table
    heads = write_table(spark, rows, "csv-heads")
    lines = next(f.name for f in heads.schema.fields if f.dataType.typeName() == "array")
    total = heads.agg(F.sum(F.octet_length(F.array_join(lines, " ")) + 100)).first()[0] or 0
    if total > HEADS_BYTES:
        raise HeadsTooLarge(f"{total} bytes")
    return [r.asDict() for r in heads.collect()]
