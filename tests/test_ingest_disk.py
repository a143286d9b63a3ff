"""The ingest marks the rows it stores in the pass over days, and leaves no steps behind on disk."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wattline.operators.changes import deadband_heartbeat, first_of_key
from wattline.session import freed_shuffles
from wattline.sources.telemetry import first_per_key, with_date


def test_first_of_key_takes_the_lowest_known_id_and_value():
    nan = float("nan")
    batch = pa.RecordBatch.from_pydict({
        "at": pa.array([1_000, 1_500, 1_900, 2_000, 2_000, 3_000, 3_001], pa.int64()),
        "id": pa.array([None, 7, 7, 4, 4, None, None], pa.int64()),
        "value": pa.array([0.0, nan, 2.0, None, 5.0, nan, None], pa.float64()),
    })
    assert first_of_key(batch, np.ones(7)).tolist() == [False, False, True, False, True, True, False]
    assert first_of_key(batch, np.array([1, 2, 3, 4, 5, 6, 7])).all()


def test_marked_rows_are_those_an_append_would_pick(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 11 != 0, F.col("id") % 17).alias("id"), (F.col("id") % 2).cast("int").alias("device_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.floor(F.col("id") / 5) * 700).alias("timestamp"),
        F.concat(F.lit("r"), F.col("id") % 3).alias("register_name"), (F.col("id") * 7 % 13).cast("double").alias("value"))
    kept = deadband_heartbeat(rows, links=False, mark=True).cache()
    columns = ["device_id", "timestamp", "register_name", "id", "value"]
    marked = with_date(kept.filter("first")).select(*columns).collect()
    wanted = first_per_key(with_date(kept.drop("first"))).select(*columns).collect()
    assert sorted(marked, key=str) == sorted(wanted, key=str)
    assert len(marked) < kept.count()


def test_freed_shuffles_puts_the_setting_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
