"""Reports and ingests from end to end, each one lazy plan."""

from wattline.catalog import MINUTE_REGISTERS, TARIFF_REGISTERS
from wattline.functions.decode import default_preprocess
from wattline.functions.time import as_timestamp, in_range, shift
from wattline.operators.changes import day_readings, deadband_heartbeat
from wattline.operators.snapshot import (
    WARM_UP, filled_long, param_history, period_stat, period_stat_long, snapshot,
)
from wattline.operators.stats import tariff_report, tariff_stats
from wattline.sources.wide import import_wide, read_wide_exports


def history(telemetry, start, end=None, fill="previous_row", newest_first=True, by_device=False, **options):
    """Filled minute history straight from telemetry, reading only the range and its warm-up.

    Where a stored minute table exists, call ``param_history`` on that instead.
    """
    low, high = as_timestamp(start), as_timestamp(end)
    # Up to the end of the last minute, which counts if it begins within the range.
    until = shift(high, "1 minute", sign=1)
    rows = telemetry.filter(in_range(telemetry, shift(low, WARM_UP), until))
    snapshots = snapshot(rows, by_device=by_device, **options)
    return param_history(snapshots, start, end, fill, by_device, newest_first=newest_first)


def period_report(telemetry, start, end=None, by_device=False, fill="previous_row", **options):
    """The statistics of a period straight from telemetry, of all devices together or of each one;
    they need no order."""
    keys = ["device_id"] if by_device else []
    if fill != "previous_row":
        filled = history(telemetry, start, end, fill, newest_first=False, by_device=by_device, **options)
        return period_stat(filled, keys)
    low, until = as_timestamp(start), shift(as_timestamp(end), "1 minute", sign=1)
    rows = telemetry.filter(in_range(telemetry, shift(low, WARM_UP), until))
    cells, present = filled_long(rows, start, end, by_device, **options)
    return period_stat_long(cells, present, keys, options.get("registers", MINUTE_REGISTERS))


def daily_tariff_report(telemetry, prices, registers=TARIFF_REGISTERS, tz="UTC"):
    """Use and cost per day, device and counter straight from telemetry."""
    return tariff_report(tariff_stats(telemetry, registers, tz=tz), prices)


def ingest_frames(frames, registers, period="20 seconds", preprocess=default_preprocess):
    """Frames to the readings worth storing: decoded, then changes and heartbeats only."""
    return deadband_heartbeat(day_readings(frames, registers, preprocess=preprocess), period, placed=True)


def ingest_exports(spark, path, known, device_id=1):
    """A folder of spreadsheet exports to readings."""
    return import_wide(read_wide_exports(spark, path), known, device_id).drop("file")
