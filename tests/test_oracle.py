"""Every registered query against its DuckDB SQL twin at sf0.01: same
columns, same types, same rows (order-insensitive)."""

import duckdb
import pytest

from tests.conftest import SF01
from tools.oracle_check import _SPARK_TO_DUCK, canon, rows_equal
from trendlens.plans import registry
from trendlens.plans.standins import TABLES

NAMES = list(registry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF01)
    cur = con.execute(registry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert df.columns == dcols
    assert [_SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in df.schema.fields] == \
        [str(d[1]) for d in cur.description]
    srows, drows = [tuple(r) for r in df.collect()], cur.fetchall()
    assert len(srows) == len(drows)
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    key = lambda r: [canon(r[i]) for i in order]
    assert rows_equal(sorted(map(key, srows), key=repr), sorted(map(key, drows), key=repr))


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["src", "dst", "cnt", "views"]
    assert df.count() > 0
