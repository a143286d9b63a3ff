"""Late rows: states that merge, streams that run a batch again, and refreshes of the days that appends touched."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattline.operators.partials import finished_stats, merged_partials, partial_stats
from wattline.operators.refresh import refresh_touched, touched_range
from wattline.operators.snapshot import snapshot
from wattline.operators.stats import bucket_stats
from wattline.session import scratch_path
from wattline.sources.telemetry import append_telemetry, logged_days
from wattline.streaming.jobs import partial_batches, read_partials

RULES = [("a", "min", "n_a"), ("a", "max>2", "x_a"), ("a", "avg", "a_a"), ("b", "range", "d_b"), ("b", "count", "c_b"),
         ("b", "delta", "t_b"), ("b", "end", "e_b"), ("a", "count>=1.5", "c_a")]


def some(telemetry, n=300, seed=1, days=6):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return telemetry([
        (r.randint(1, 2), start + dt.timedelta(seconds=i * 86_400 * days // n), r.choice(["a", "b", "other"]),
         r.choice([None, 1.0, 1.5, 2.0, 3.25])) for i in range(n)])


def stats(df):
    return rows(bucket_stats(df, "1 day", RULES))


def test_merged_states_equal_the_statistics(telemetry):
    df = some(telemetry)
    parts = [partial_stats(df.filter(F.col("id") % 3 == i), "1 day", RULES) for i in (2, 0, 1)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(finished_stats(merged_partials(both, RULES), RULES)) == stats(df)
    assert finished_stats(merged_partials(both.where("false"), RULES), RULES).count() == 0


def test_a_batch_that_runs_again_adds_nothing_twice(spark, telemetry):
    df, path = some(telemetry), scratch_path(spark, "states")
    write = partial_batches(spark, path, "1 day", RULES)
    first, second, late = (df.filter(c) for c in ("id < 150 and id % 4 > 0", "id >= 150 and id % 4 > 0", "id % 4 = 0"))
    for number, batch in ((0, first), (0, first), (1, second), (2, late), (2, late), (3, df.where("false"))):
        write(batch, number)
    assert rows(finished_stats(read_partials(spark, path), RULES)) == stats(df)


@pytest.mark.parametrize("width", ["1 day", "1 hour", "7 minutes"])
def test_touched_days_are_rebuilt_whatever_their_age(spark, telemetry, width):
    df, path = some(telemetry, 400), scratch_path(spark, "touched")
    built = []

    def build(t):
        built.append(sorted({r[0].isoformat() for r in t.select(F.to_date("timestamp")).distinct().collect()}))
        return snapshot(t, width, ["a", "b"], by_device=True)

    late = (F.col("id") % 5 == 0) & F.to_date("timestamp").isin("2024-01-02", "2024-01-04")
    for part in (df.filter(~late), df.filter(late)):
        append_telemetry(spark, part, f"{path}/t", f"{path}/log")
        refresh_touched(spark, f"{path}/t", build, f"{path}/s", f"{path}/log", width, "minutets")
    assert rows(spark.read.parquet(f"{path}/s").drop("date")) == rows(snapshot(df, width, ["a", "b"], by_device=True))
    if width != "7 minutes":
        assert built[1] == ["2024-01-02", "2024-01-04"]
    assert logged_days(spark, f"{path}/log") == ([], [])
    assert refresh_touched(spark, f"{path}/t", build, f"{path}/s", f"{path}/log", width, "minutets") == []


def test_a_failed_refresh_is_repeated(spark, telemetry):
    df, path = some(telemetry, 60), scratch_path(spark, "failed")
    append_telemetry(spark, df, f"{path}/t", f"{path}/log")

    def broken(t):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        refresh_touched(spark, f"{path}/t", broken, f"{path}/s", f"{path}/log", "1 day", "metricts")
    refresh_touched(spark, f"{path}/t", lambda t: bucket_stats(t, "1 day", RULES), f"{path}/s", f"{path}/log", "1 day", "metricts")
    assert rows(spark.read.parquet(f"{path}/s").drop("date")) == stats(df)


def test_days_that_buckets_reach_over():
    day = dt.date(2024, 1, 2)
    assert touched_range(day, "1 hour") == {day} and touched_range(day, "1 day") == {day}
    assert touched_range(day, "7 minutes") >= {day} and len(touched_range(day, "7 minutes")) > 1
