import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        # Tiny inputs: compiling whole stages would take most of the time.
        .config("spark.sql.codegen.wholeStage", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def lines(spark):
    """Lines of one stream: bodies get a prefix, one second apart unless (second, body) is given."""

    def make(bodies, player="Izzin", stream="s"):
        import datetime as dt

        rows = []
        t0 = dt.datetime(2026, 2, 27, 22, 0, 0)
        for i, b in enumerate(bodies):
            sec, body = b if isinstance(b, tuple) else (i, b)
            stamp = (t0 + dt.timedelta(seconds=sec)).strftime("[%a %b %d %H:%M:%S %Y] ")
            rows.append((stream, player, i + 1, stamp + body))
        return spark.createDataFrame(rows, "stream_id string, player string, line_no long, raw string")

    return make
