"""The ingest goes through readings once: what a day keeps in any case is stored, the rest is chained."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattline.operators import changes
from wattline.operators.changes import (
    by_series, day_readings, deadband_heartbeat, heartbeat_once, next_emitted, reached_rows,
)
from wattline.plans.reports import ingest_frames

START = 1_704_067_200_000_000


def readings(spark, seed, n=3000, days=6):
    """Series that jump, stand still, tie in time and id, and lack values and ids."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        device, register = int(rng.integers(1, 4)), ["jump", "still", "slow"][int(rng.choice(3, p=[.4, .3, .3]))]
        at = START + int(rng.integers(0, days * 400)) * 216_000_000 + int(rng.integers(0, 3)) * 400
        value = {"jump": float(rng.integers(0, 5)), "still": 7.0, "slow": (at - START) / 1e9}[register]
        value = [value, None, float("nan")][int(rng.choice(3, p=[.98, .01, .01]))]
        rows.append((int(rng.integers(0, 40)) if rng.random() < .9 else None, device, register, value, at))
    df = spark.createDataFrame(rows, "id long, device_id int, register_name string, value double, at long")
    return df.withColumn("timestamp", F.timestamp_micros("at")).drop("at")


def plain(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


COLUMNS = ["id", "device_id", "timestamp", "register_name", "value", "first"]


@pytest.mark.parametrize("seed, period, eps", [(1, "20 seconds", 1e-9), (2, "10 minutes", 1e-9), (3, "1 minute", 1.5), (4, "2 hours", 0.3)])
def test_one_pass_keeps_what_two_passes_keep(spark, tmp_path, seed, period, eps):
    rows = readings(spark, seed)
    state = None
    for number, part in enumerate((rows.filter("timestamp < '2024-01-03 07:00:00'"), rows.filter("timestamp >= '2024-01-03 07:00:00'"))):
        want = deadband_heartbeat(part, period, eps, resume_from=state, links=False, mark=True)
        kept, ends, days = heartbeat_once(
            part, f"{tmp_path}/{number}", period, eps, resume_from=state, placed=False)
        assert plain(kept, *COLUMNS) == plain(want, *COLUMNS)
        tops = want.groupBy("device_id", "register_name").agg(F.max("timestamp").alias("t"))
        found = {(r[0], r[1]): r[2] for r in ends.select("device_id", "register_name", "timestamp").collect()}
        assert all(found[r["device_id"], r["register_name"]] == r["t"] for r in tops.collect())
        assert {r[0] for r in days.distinct().collect()} >= {r[0] for r in want.select(F.to_date("timestamp")).distinct().collect()}
        state = spark.createDataFrame(ends.collect(), ends.schema)


def test_a_state_newer_than_late_rows_stays(spark, tmp_path, telemetry):
    state = telemetry([(1, "2024-01-09 00:00:00", "a", 1.0), (2, "2024-01-09 00:00:00", "b", 4.0)]).drop("id")
    rows = telemetry([(1, "2024-01-02 00:00:00", "a", 9.0), (1, "2024-01-02 01:00:00", "c", 2.0)])
    _, ends, _ = heartbeat_once(rows, str(tmp_path / "x"), resume_from=state, placed=False)
    assert plain(ends, "device_id", "register_name", "timestamp", "value") == [
        ("1", "a", "2024-01-09 00:00:00", "1.0"), ("1", "c", "2024-01-02 01:00:00", "2.0"),
        ("2", "b", "2024-01-09 00:00:00", "4.0")]


def test_no_rows_and_a_state(spark, tmp_path, telemetry):
    state = telemetry([(1, "2024-01-09 00:00:00", "a", 1.0)]).drop("id")
    kept, ends, days = heartbeat_once(state.withColumn("id", F.lit(1)).limit(0), str(tmp_path / "x"), resume_from=state, placed=False)
    assert kept.count() == 0 and ends.count() == 1 and days.count() == 0


def test_rows_of_a_device_are_put_in_order_of_series(spark):
    rows = readings(spark, 9).withColumns({"chunk": F.floor(F.unix_micros("timestamp") / 86_400_000_000).cast("int"),
                                           "at": F.unix_micros("timestamp")}).drop("timestamp")
    columns = ["device_id", "chunk", "register_name", "at", "id", "value"]
    data = [tuple(r) for r in rows.select(*columns).orderBy("device_id", "chunk", F.rand(1)).collect()]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*data), types)], columns)
    got = by_series(batch)
    # Within a place only rows of one register are in a given order.
    series = {}
    for r in zip(*(got.column(c).to_pylist() for c in columns)):
        series.setdefault(r[:3], []).append(tuple(map(str, r[3:])))
    want = {}
    for r in rows.select(*columns).orderBy(*columns).collect():
        want.setdefault(tuple(r[:3]), []).append(tuple(map(str, r[3:])))
    assert series == want


def test_reached_rows_follow_the_chain():
    rng = np.random.default_rng(5)
    t, v = np.cumsum(rng.integers(1, 4, 3000)), rng.choice([0.0, 0.0, 0.0, 1.0, 5.0], 3000)
    ends = np.repeat(np.arange(100, 3001, 100), 100)
    following = next_emitted(t, v, ends, 1.0, 40)
    first, last = np.arange(0, 3000, 100) + rng.integers(0, 101, 30), np.arange(100, 3001, 100)
    want = []
    for row, end in zip(first, last):
        while row < end:
            want.append(int(row))
            row = following[row]
    assert reached_rows(first, last, following).tolist() == want


def frames_of(spark):
    return spark.range(4000).select(
        (F.col("id") % 3 + 1).cast("int").alias("device_id"), F.lit("holding").alias("reg_type"),
        F.timestamp_micros(F.lit(START) + F.floor(F.col("id") * 7919 % 4001 / 3) * 300_000_000).alias("ts"),
        F.lit(500).alias("start"), F.array((F.col("id") * 37 % 5).cast("int"), F.lit(3)).alias("words"),
        (F.col("id") % 900).alias("frame_id"))


def catalog_of(spark):
    return spark.sql("""SELECT d AS device_id, 'holding' AS reg_type, * FROM VALUES (500, 'a', 'uint16', 1.0D, false, true, 0),
        (501, 'b', 'uint16', 1.0D, false, true, 1), (500, 'c', 'uint32', 1.0D, false, true, 2)
        AS t(address, name, type, scale, preprocessing, enabled, register_no) JOIN (SELECT explode(array(1, 2, 3)) AS d)""")


@pytest.mark.parametrize("period", ["10 minutes", "20 seconds"])
def test_frames_are_dealt_out_before_they_become_readings(spark, monkeypatch, period):
    kept = ingest_frames(frames_of(spark), catalog_of(spark), period)
    found = plain(kept, *COLUMNS[:-1])
    monkeypatch.setattr(changes, "TASK_REGISTERS", 0)
    assert found == plain(ingest_frames(frames_of(spark), catalog_of(spark), period), *COLUMNS[:-1])
    assert len(found) > 100


def test_no_shuffle_of_readings_and_no_table_of_them(spark):
    rows = day_readings(frames_of(spark), catalog_of(spark))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    # The one shuffle lies below the join with the catalog.
    lines = plan.split("\n")
    shuffle, join = ([i for i, x in enumerate(lines) if name in x] for name in ("Exchange hashpartitioning", "BroadcastHashJoin"))
    assert len(shuffle) == 1 and len(join) == 1 and shuffle[0] > join[0]


def test_arrow_batches_are_not_measured_row_by_row(spark):
    from wattline.llm.common import prepare
    from wattline.session import tune

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tune(spark).conf.get(key) == "2147483647"
    try:
        assert prepare(spark).conf.get(key) != "2147483647"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        tune(spark)
