"""Compare every registered query with its DuckDB SQL twin.

    python tools/oracle_check.py [sf_dir] [name ...]

Prints one line per query: rows on both sides, column names, a type check
and an order-insensitive value comparison. Exit code 1 if any differs.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from trendlens.plans import registry  # noqa: E402
from trendlens.plans.standins import TABLES  # noqa: E402
from trendlens.session import get_spark  # noqa: E402

_SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def canon(v):
    if v is None:
        return ("~null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, decimal.Decimal)):
        return ("n", float(v)) if isinstance(v, decimal.Decimal) else ("n", v)
    if isinstance(v, float):
        return ("n", v if math.isfinite(v) else str(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    return ("s", str(v))


TOL = float(os.environ.get("ORACLE_TOL", "0"))


def rows_equal(a, b, tol=None):
    tol = TOL if tol is None else tol
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if x == y:
                continue
            if x[0] == y[0] == "n" and isinstance(x[1], (int, float)) and isinstance(y[1], (int, float)):
                if abs(x[1] - y[1]) <= tol * max(1.0, abs(x[1]), abs(y[1])):
                    continue
            return False
    return True


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    sqls = registry.oracle_sql()
    bad = 0
    for name, build in registry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = build(spark, sf_dir)
            cols = df.columns
            stypes = [f.dataType.simpleString() for f in df.schema.fields]
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = sqls.get(name)
        if sql is None:
            print(f"ROWS {name}: spark {len(srows)} rows, no oracle ({ts:.2f}s)")
            continue
        t0 = time.time()
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            dtypes = [str(d[1]) for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        td = time.time() - t0
        problems = []
        if cols != dcols:
            problems.append(f"columns {cols} vs {dcols}")
        tmis = [(c, s, d) for c, s, d in zip(cols, stypes, dtypes) if _SPARK_TO_DUCK.get(s, s) != d]
        if tmis:
            problems.append(f"types {tmis}")
        if len(srows) != len(drows):
            problems.append(f"rows {len(srows)} vs {len(drows)}")
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        key = lambda r: [canon(r[i]) for i in order]
        a = sorted((key(r) for r in srows), key=repr)
        b = sorted((key(r) for r in drows), key=repr)
        if not rows_equal(a, b):
            diff = [x for x in a if x not in b][:3]
            problems.append(f"values differ, e.g. spark-only {diff} / duck-only {[x for x in b if x not in a][:3]}")
        status = "OK  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {name}: {len(srows)} rows spark {ts:.2f}s duckdb {td:.2f}s {'; '.join(problems)}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
