"""Statistics from the long form of the filled history against those from whole rows."""

import random

import pytest

from conftest import rows
from wattline.catalog import MINUTE_REGISTERS
from wattline.operators.snapshot import filled_long, period_stat
from wattline.plans.reports import history, period_report

SOME = [MINUTE_REGISTERS[i] for i in (0, 3, 5, 8, 20)] + ["unlisted"]


def readings(seed, n=400):
    """Sparse readings of three days, some NULL, many in one minute, an empty day between."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        day, minute = r.choice([9, 10, 12]), r.randrange(0, 1440, r.choice([1, 7, 60]))
        value = r.choice([None, 0.0, 1.5, float(r.randrange(300))])
        out.append((r.randrange(1, 4), f"2024-01-{day:02} {minute // 60:02}:{minute % 60:02}:{r.randrange(60):02}",
                    r.choice(SOME), value))
    # Readings of one device and time would leave the last one open.
    return list({x[:3]: x for x in out}.values())


@pytest.mark.parametrize("by_device", [False, True])
@pytest.mark.parametrize("start, end", [
    ("2024-01-10 00:00:00", "2024-01-13 00:00:00"), ("2024-01-10 00:00:30", "2024-01-12 11:11:11"),
    ("2024-01-12 05:00:00", "2024-01-12 05:00:00"), ("2025-01-01", "2025-01-02"),
])
def test_long_form_equals_whole_rows(spark, telemetry, by_device, start, end):
    data = telemetry(readings(by_device * 10 + len(end)))
    keys = ["device_id"] if by_device else []
    want = period_stat(history(data, start, end, newest_first=False, by_device=by_device), keys)
    got = period_report(data, start, end, by_device)
    assert got.columns == want.columns
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == pytest.approx(b, nan_ok=True)


def test_long_form_keeps_devices_without_values(spark, telemetry):
    data = telemetry([(1, "2024-01-10 10:00:00", SOME[0], None), (2, "2024-01-10 10:00:00", SOME[0], 2.0)])
    assert [r["device_id"] for r in period_report(data, "2024-01-10", "2024-01-11", True).orderBy("device_id").collect()] == [1, 2]
    assert period_report(data.limit(0), "2024-01-10", "2024-01-11").count() == 1


def test_reading_counts_in_its_minute_and_the_next_one_present(spark, telemetry):
    a, b = SOME[:2]
    data = telemetry([
        (1, "2024-01-10 10:00:05", a, 1.0), (1, "2024-01-10 10:05:00", b, 2.0), (1, "2024-01-10 10:09:00", b, 3.0),
        (1, "2024-01-12 00:00:00", "unlisted", 1.0),
    ])
    cells, present = filled_long(data, "2024-01-10", "2024-01-13")
    assert rows(cells.select("time", "register_name", "value")) == sorted([
        ("2024-01-10 10:00:00", a, 1.0), ("2024-01-10 10:05:00", a, 1.0), ("2024-01-10 10:05:00", b, 2.0),
        ("2024-01-10 10:09:00", b, 3.0), ("2024-01-12 00:00:00", b, 3.0)])
    assert present.count() == 4
