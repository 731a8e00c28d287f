import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from slicewise.session import configure
    s = (SparkSession.builder.master("local[*]").appName("slicewise-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    if not s.conf.get("spark.checkpoint.dir", None):       # tests only: set one where none is configured
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="slicewise-test-ckpt-"))
    configure(s)
    s.sparkContext.setLogLevel("ERROR")
    yield s
