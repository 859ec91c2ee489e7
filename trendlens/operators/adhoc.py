"""Bounded ad-hoc SELECT: at most ``max_rows`` rows ever reach the driver, and work ends at a deadline."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from trendlens.functions.output import json_safe

# One closing semicolon, with only comments behind it.
_END = re.compile(r";\s*(?:--[^\n]*\s*)*$")


@dataclass
class BoundedResult:
    columns: list[str]
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    elapsed_ms: float = 0.0

    @property
    def row_count(self) -> int:
        return len(self.rows)


def bounded_frame(spark: SparkSession, sql: str, max_rows: int = 1000,
                  views: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query as a lazy, JSON-safe DataFrame cut to ``max_rows`` rows.

    The text is placed as a subquery, where Spark's parser accepts nothing
    but a query (commands and edits are syntax errors before anything runs).
    ``views`` names DataFrames for this query only. Without an ORDER BY in
    the query, which rows survive the cut is up to Spark (as it is up to any
    engine).
    """
    if not (sql or "").strip():
        raise ValueError("no query")
    query = f"SELECT * FROM (\n{_END.sub('', sql.strip())}\n)"
    given = {name: f"adhoc_{uuid.uuid4().hex}" for name in views or {}}
    try:
        for name, view in given.items():
            views[name].createOrReplaceTempView(view)
        named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in given.items())
        return json_safe(spark.sql(f"WITH {named} {query}" if named else query)).limit(int(max_rows))
    finally:  # the query is analysed: its views are no longer looked up
        for view in given.values():
            spark.catalog.dropTempView(view)


class TooLarge(ValueError):
    """The query joins without equal keys, and the joined sides are larger than allowed."""


class DeadlineExceeded(TimeoutError):
    """The query was cancelled at its deadline."""


def _nodes(plan) -> list:
    """A JVM plan's nodes, those below adaptive execution and its stages included."""
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append(node)
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.inputPlan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def pair_join_bytes(df: DataFrame) -> int:
    """Estimated size of the largest join without equal keys in the plan (its sides' sizes multiplied); 0 without one."""
    largest = 0
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() in ("CartesianProductExec", "BroadcastNestedLoopJoinExec"):
            sides = node.children()
            size = 1
            for i in range(sides.size()):
                link = sides.apply(i).logicalLink()
                size *= int(link.get().stats().sizeInBytes()) if link.isDefined() else 1
            largest = max(largest, size)
    return largest


def within(spark: SparkSession, seconds: float | None, job):
    """``job()``, its Spark jobs cancelled once ``seconds`` have passed; no job is left running then."""
    if seconds is None:
        return job()
    context, group = spark.sparkContext, f"adhoc-{uuid.uuid4().hex}"
    kept = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    over, done = threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        over.set()
        while True:  # a query may begin another job after the first is cancelled
            context.cancelJobGroup(group)
            if done.wait(0.5):
                return

    context.setJobGroup(group, "ad-hoc query", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return job()
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"cancelled after {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        for key, value in kept.items():
            context.setLocalProperty(key, value)


def bounded_select(spark: SparkSession, sql: str, max_rows: int = 1000, views: dict[str, DataFrame] | None = None,
                   deadline: float | None = None, max_pair_bytes: int | None = None) -> BoundedResult:
    """Run the query and fetch ``max_rows + 1`` rows at most, so ``truncated``
    is known without counting the full result.

    Rows are bounded by that, work by the other two: after ``deadline`` seconds the
    query is cancelled (``DeadlineExceeded``); a join without equal keys whose sides'
    estimated bytes multiply to more than ``max_pair_bytes`` is refused before
    it runs (``TooLarge``). Spark cannot interrupt a task between two rows of such a
    join, so the refusal is what bounds it (on a cluster, ``spark.task.reaper.enabled``
    ends such tasks too).
    """
    start = time.perf_counter()

    def job() -> BoundedResult:
        df = bounded_frame(spark, sql, max_rows + 1, views)
        if max_pair_bytes is not None and (size := pair_join_bytes(df)) > max_pair_bytes:
            raise TooLarge(f"a join without equal keys over about {size} bytes (pairs); at most {max_pair_bytes} allowed")
        rows = [tuple(r) for r in df.collect()]
        return BoundedResult(columns=list(df.columns), rows=rows[:max_rows], truncated=len(rows) > max_rows)

    result = within(spark, deadline, job)
    result.elapsed_ms = round((time.perf_counter() - start) * 1000.0, 2)
    return result
