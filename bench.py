"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (sum of per-query medians, sec),
"unit", "queries": {name: sec}, "sf", ...}. Each query is run once to warm
up and then timed 3 times (median); a run executes the whole plan into
Spark's no-op sink, so nothing is collected. The one-off build of the clean
and tag tables (the "create table as select" step of the original app) is
timed separately as ``etl`` and added in ``value_with_builds``. The matching
DuckDB texts run on the same thread count, on stand-in tables that DuckDB has
built once too (``duckdb_builds``), into temporary tables (``duckdb``).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
WITH_DUCKDB = os.environ.get("BENCH_DUCKDB", "1") != "0"
# The DuckDB reference timings are skipped when the Spark part has already
# used this many seconds.
BUDGET = float(os.environ.get("BENCH_BUDGET_SEC", "900"))
START = time.perf_counter()


def _sf(path: str):
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main() -> None:
    from trendlens.plans import registry
    from trendlens.plans.tables import csv_export, raw_snapshots_table, raw_table, tags_table, trending_table
    from trendlens.session import get_spark

    spark = get_spark(f"local[{CPUS}]", app="trendlens-bench",
                      shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", CPUS)),
                      extra={"spark.driver.memory": "16g",
                             **({"spark.sql.sources.fileCompressionFactor": os.environ["BENCH_FCF"]}
                                if os.environ.get("BENCH_FCF") else {})})
    etl = {}
    t0 = time.perf_counter()
    trending_table(spark, SF_DIR)
    etl["clean_table"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    tags_table(spark, SF_DIR)
    etl["tag_table"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    raw_table(spark, SF_DIR)
    raw_snapshots_table(spark, SF_DIR)
    etl["raw_tables"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    csv_export(spark, SF_DIR)
    etl["csv_export"] = round(time.perf_counter() - t0, 3)

    times, errors = {}, {}
    only = {n for n in os.environ.get("BENCH_ONLY", "").split(",") if n}
    for name, build in registry.queries().items():
        if only and name not in only:
            continue
        runs = []
        try:
            for i in range(RUNS + 1):
                t0 = time.perf_counter()
                build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
                if i:
                    runs.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # noqa: BLE001 -- record and go on: one JSON line must come out
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    spark.stop()

    duck, duck_builds = {}, {}
    if WITH_DUCKDB and time.perf_counter() - START < BUDGET:
        import duckdb
        from trendlens.plans import standins as st
        con = duckdb.connect()
        con.execute(f"SET threads = {CPUS}")
        for t in st.TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
        # The same stand-in tables, built once here too, and read by the twins.
        built = {"built_raw_trending": st.raw_trending_sql(st.DUCKDB_REFS), "built_raw": st.raw_sql(st.DUCKDB_REFS),
                 "built_trending": st.TRENDING_SQL}
        for table, sql in built.items():
            t0 = time.perf_counter()
            con.execute(f"CREATE TABLE {table} AS {sql}")
            duck_builds[table] = round(time.perf_counter() - t0, 3)
        for name, sql in registry.oracle_sql().items():
            if only and name not in only:
                continue
            for table, body in sorted(built.items(), key=lambda x: -len(x[1])):
                sql = sql.replace(body, f"SELECT * FROM {table}")
            runs = []
            for i in range(RUNS + 1):
                t0 = time.perf_counter()
                con.execute(f"CREATE OR REPLACE TEMP TABLE sink AS {sql}")  # stays in DuckDB, as a no-op sink does
                if i:
                    runs.append(time.perf_counter() - t0)
            duck[name] = round(statistics.median(runs), 3)

    total = round(sum(times.values()), 3)
    duck_total = round(sum(duck.values()), 3)
    print(json.dumps({"metric": "sum_of_query_medians", "value": total, "unit": "sec", "queries": times,
                      "sf": _sf(SF_DIR), "cpus": CPUS, "runs": RUNS, "etl": etl,
                      "value_with_builds": round(total + sum(etl.values()), 3), "errors": errors, "duckdb": duck,
                      "duckdb_builds": duck_builds, "duckdb_total": duck_total if duck else None,
                      "duckdb_with_builds": round(duck_total + sum(duck_builds.values()), 3) if duck else None}))


if __name__ == "__main__":
    main()
