import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    warehouse = tempfile.mkdtemp(prefix="trendlens-wh-")
    s = (SparkSession.builder.master("local[*]").appName("trendlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", warehouse)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # Tests set their own checkpoint folder only when the session has none.
    from trendlens.session import shared_dir
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="trendlens-test-")
