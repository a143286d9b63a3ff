"""Incremental upkeep of aggregate tables: whole buckets recomputed and put in place."""

import datetime as dt

from pyspark.sql import functions as F

from wattline.functions.time import (
    ORIGIN_SECONDS, as_datetime, as_timestamp, in_range, utc_date, width_micros,
)
from wattline.schemas import STORED_TELEMETRY
from wattline.session import scratch_path
from wattline.sources.telemetry import (
    clear_log, days_of, logged_days, read_days, remove_days, write_by_date,
)

# How far back and up to when the scheduled refresh of each aggregate looks.
MINUTE_OFFSETS = ("2 hours", "1 minute")
DAY_OFFSETS = ("14 days", None)


def refresh_window(now, offsets, width):
    """The whole buckets inside ``[now - offsets[0], now - offsets[1])``, as two datetimes."""
    now = as_datetime(now)
    start_offset, end_offset = offsets
    low = now - dt.timedelta(microseconds=width_micros(start_offset))
    high = now - dt.timedelta(microseconds=width_micros(end_offset)) if end_offset else now
    return whole_buckets(low, high, width)


def whole_buckets(low, high, width):
    """The range shrunk to whole buckets."""
    size = dt.timedelta(microseconds=width_micros(width))
    origin = dt.datetime.fromtimestamp(ORIGIN_SECONDS, dt.timezone.utc)
    low, high = as_datetime(low), as_datetime(high)
    first = origin + -((origin - low) // size) * size
    last = origin + ((high - origin) // size) * size
    return first, max(first, last)


def refreshed(existing, telemetry, build, window, time):
    """The aggregate after a refresh: recomputed inside the window, unchanged outside.

    ``build`` makes the aggregate from telemetry. Buckets are never merged from parts, as first
    and last values cannot be without their times.
    """
    low, high = as_timestamp(window[0]), as_timestamp(window[1])
    fresh = build(telemetry.filter(in_range(telemetry, low, high, high_open=True)))
    if existing is None:
        return fresh
    inside = (F.col(time) >= low) & (F.col(time) < high)
    return existing.filter(~inside).unionByName(fresh)


def refresh_table(spark, telemetry, build, path, window, time):
    """Refreshes the stored aggregate (writes).

    Only the folders of the touched days are replaced, and only when the job commits, so a
    failed or repeated refresh leaves a whole table. Days of the window that have no rows any more
    are then removed; a refresh that ends before that removes them when it is repeated.
    """
    if window[0] >= window[1]:
        return
    first, last = as_datetime(window[0]).date(), as_datetime(window[1]).date()
    window_days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    existing, stored_days = read_days(spark, path, window_days), []
    if existing is not None:
        stored_days = days_of(existing)
        existing = existing.drop("date")
    _put(spark, refreshed(existing, telemetry, build, window, time), path, time, stored_days)


def _put(spark, table, path, time, stored_days):
    """Replaces the days of a table by its rows, and removes those of the stored days that have none. The
    rows are computed once, to a table beside."""
    beside = scratch_path(spark, "refreshed")
    table.withColumn("date", utc_date(F.col(time))).write.parquet(beside)
    table = spark.read.parquet(beside)
    days = set(days_of(table)) if stored_days else set()
    write_by_date(table, path, mode="overwrite", sort=())
    remove_days(spark, path, [day for day in stored_days if day not in days])


def touched_buckets(spark, days, width, time):
    """(time): the buckets that have a part in any of the days."""
    size = width_micros(width)
    since = F.unix_micros(F.col("date").cast("timestamp")) - F.lit(ORIGIN_SECONDS * 1_000_000)
    first, last = F.floor(since / size), F.floor((since + F.lit(86_400_000_000 - 1)) / size)
    dated = spark.createDataFrame([(day,) for day in days], "date date")
    numbers = dated.select(F.explode(F.sequence(first, last)).alias("number")).distinct()
    at = F.col("number") * F.lit(size) + F.lit(ORIGIN_SECONDS * 1_000_000)
    return numbers.select(F.timestamp_micros(at).alias(time))


def touched_range(day, width):
    """The days that the buckets of a day reach over."""
    size = dt.timedelta(microseconds=width_micros(width))
    origin = dt.datetime.fromtimestamp(ORIGIN_SECONDS, dt.timezone.utc)
    start = dt.datetime.combine(day, dt.time(), dt.timezone.utc)
    low = origin + (start - origin) // size * size
    high = origin - (origin - start - dt.timedelta(days=1)) // size * size - dt.timedelta(microseconds=1)
    return {low.date() + dt.timedelta(days=i) for i in range((high.date() - low.date()).days + 1)}


def refresh_touched(spark, telemetry_path, build, path, log, width, time):
    """Rebuilds the buckets of the days that appends have logged since the last time (writes), whatever
    their age; returns those days.

    Only the folders of these days, and of days that their buckets reach over, are read and replaced. The
    log's files are removed last, so that a refresh that fails is repeated whole.
    """
    days, files = logged_days(spark, log)
    if days:
        reach = sorted(set().union(*(touched_range(day, width) for day in days)))
        buckets = touched_buckets(spark, days, width, time)
        telemetry = read_days(spark, telemetry_path, reach, STORED_TELEMETRY)
        fresh = build(telemetry.drop("date")).join(buckets, time, "left_semi") if telemetry is not None else None
        existing, stored_days = read_days(spark, path, reach), []
        if existing is not None:
            stored_days = days_of(existing)
            existing = existing.drop("date").join(buckets, time, "left_anti")
        parts = [x for x in (existing, fresh) if x is not None]
        if parts:
            _put(spark, parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0], path, time, stored_days)
    clear_log(spark, files)
    return days


def upsert_table(spark, rows, path, keys, time):
    """Replaces or adds rows by key in the days they touch (writes); safe to repeat.

    ``rows`` is read several times: it should be a table or a persisted batch.
    """
    dated = rows.withColumn("date", utc_date(F.col(time)))
    merged = dated
    stored = read_days(spark, path, days_of(dated))
    if stored is not None:
        merged = stored.join(dated.select(*keys), keys, "left_anti").unionByName(dated)
    write_by_date(merged, path, mode="overwrite", sort=())
