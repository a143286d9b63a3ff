"""The long form of the filled history: against plain Python, and without tables of groups over doubled rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattline.catalog import MINUTE_REGISTERS
from wattline.operators.snapshot import by_place_in_bucket, by_time_and_device, filled_long

LOW, HIGH = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 14)


def brute(data, by_device):
    last, present = {}, {}
    for device, time, register, value in sorted(data, key=lambda x: (x[1], x[0])):
        minute = dt.datetime.fromisoformat(time).replace(second=0)
        key = device if by_device else None
        if LOW - dt.timedelta(days=1) <= minute <= HIGH:
            present.setdefault(key, set()).add(minute)
            last[key, minute, register] = value
    out = []
    for key, minutes in present.items():
        order = sorted(minutes)
        for minute, before in zip(order, [None, *order]):
            for r in MINUTE_REGISTERS:
                value = last.get((key, minute, r))
                value = last.get((key, before, r)) if value is None else value
                if minute >= LOW and value is not None:
                    out.append((*([key] if by_device else []), str(minute), r, value))
    return sorted(out, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("by_device", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_filled_long_as_plain_python(spark, telemetry, seed, by_device):
    r = random.Random(seed)
    names = [*MINUTE_REGISTERS[:3], "unlisted"]
    data = {}
    for _ in range(500):
        # Many readings lie at the ends of days, and a day is left out.
        minute = r.choice([0, 1, 1438, 1439, r.randrange(1440)])
        time = f"2024-01-{r.choice([9, 10, 11, 13]):02} {minute // 60:02}:{minute % 60:02}:{r.randrange(60):02}"
        row = (r.randrange(1, 3), time, r.choice(names), r.choice([None, 0.0, float(r.randrange(9))]))
        data[row[:3]] = row
    data = list(data.values())
    cells, present = filled_long(telemetry(data), LOW, HIGH, by_device)
    keys = ["device_id"] if by_device else []
    want = brute(data, by_device)
    assert len(want) > 50
    assert rows(cells.select(*keys, "time", "register_name", "value")) == want
    assert present.count() >= len({x[:-2] for x in want})


def test_cells_are_grouped_once(telemetry):
    cells, _ = filled_long(telemetry([(1, "2024-01-10 10:00:05", MINUTE_REGISTERS[0], 1.0)]), LOW, HIGH)
    plan = cells._jdf.queryExecution().sparkPlan().toString()
    # In part and in whole: no second table of groups, over the readings with their copies.
    assert plan.count("max_by(") <= 2 and "max_by(value" in plan


@pytest.mark.parametrize("width, kind", [("1 minute", "bigint"), ("35 minutes", "bigint"), ("1 hour", "decimal(32,0)"), ("1 month", "decimal(32,0)")])
def test_place_in_a_bucket_orders_as_time_and_device(telemetry, width, kind):
    times = [f"2024-01-10 10:{m:02}:{s:02}.{u}" for m, s, u in [(0, 0, "000001"), (0, 0, "000002"), (0, 59, "9"), (9, 0, "0")]]
    data = telemetry([(d, t, "a", 1.0) for t in times for d in (-2**31, -1, 0, 2**31 - 1)])
    places = data.select("device_id", "timestamp", by_place_in_bucket(width).alias("place"), by_time_and_device().alias("whole"),
                         F.date_trunc("minute", "timestamp").alias("m"))
    if kind == "bigint":
        assert dict(places.dtypes)["place"] == kind
    found = places.collect()
    for m in {r["m"] for r in found} if width == "1 minute" else [None]:
        these = [r for r in found if m is None or r["m"] == m]
        by = [sorted(these, key=lambda r: r[c]) for c in ("place", "whole")]
        assert by[0] == by[1]
