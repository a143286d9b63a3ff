import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import cloudpickle  # noqa: E402

import wattline  # noqa: E402
from wattline.schemas import TELEMETRY  # noqa: E402
from wattline.session import build_session  # noqa: E402

cloudpickle.register_pickle_by_value(wattline)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-"),
    })
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def telemetry(spark):
    """Readings from rows (device, time, register, value)."""

    def make(rows):

        from pyspark.sql import functions as F

        data = [(i, d, str(t), r, v) for i, (d, t, r, v) in enumerate(rows)]
        raw = spark.createDataFrame(
            data, "id long, device_id int, timestamp string, register_name string, value double"
        )
        return raw.withColumn("timestamp", F.to_timestamp("timestamp")).select(*TELEMETRY.fieldNames())

    return make


def rows(df, *order):
    """Rows as tuples with times as text, in the given order or sorted."""
    out = [tuple(str(x) if hasattr(x, "isoformat") else x for x in r) for r in df.collect()]
    return out if order == ("as is",) else sorted(out, key=lambda r: tuple(str(x) for x in r))
