"""Time literals, ranges and buckets. Everything is UTC and works on microseconds since 1970."""

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket origin (Monday 2000-01-03 00:00 UTC) and unit lengths in seconds.
ORIGIN_SECONDS = 946_857_600
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}

DAY_MICROS = 86_400 * 1_000_000


def as_timestamp(value):
    """A timestamp column from a column, a datetime, or text. Without a zone, UTC is meant."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    return F.lit(as_datetime(value).isoformat(" ")).cast("timestamp")


def as_datetime(value):
    """An aware datetime from a datetime or text."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


def width_micros(width):
    """Length of ``'4 hours'``, ``'1 minute'`` or a timedelta, in microseconds."""
    if isinstance(width, dt.timedelta):
        return width // dt.timedelta(microseconds=1)
    match = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", width.lower())
    if not match or match[2] not in UNIT_SECONDS or int(match[1]) == 0:
        raise ValueError(f"not a fixed width: {width!r}")
    return int(match[1]) * UNIT_SECONDS[match[2]] * 1_000_000


def width_months(width):
    """Number of months in ``'1 month'`` or ``'1 year'``; None for a fixed width."""
    if isinstance(width, str):
        match = re.fullmatch(r"\s*(\d+)\s+(month|year)s?\s*", width.lower())
        if match:
            return int(match[1]) * (12 if match[2] == "year" else 1)
    return None


def shift(ts, width, sign=-1):
    """``ts`` moved by a fixed width (back by default)."""
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(sign * width_micros(width)))


def bucket_offset(width):
    """Microseconds from 1970 to the first bucket that begins after it."""
    return (ORIGIN_SECONDS * 1_000_000) % width_micros(width)


def bucket_micros(micros, width):
    """Start of the bucket holding an instant given in microseconds."""
    return micros - F.pmod(micros - F.lit(bucket_offset(width)), F.lit(width_micros(width)))


def bucket(ts, width):
    """Start of the bucket of ``width`` that holds ``ts``."""
    months = width_months(width)
    if months:
        index = F.floor((F.year(utc_date(ts)) * 12 + F.month(utc_date(ts)) - 1 - 24_000) / months)
        first = F.add_months(F.lit("2000-01-01").cast("date"), (index * months).cast("int"))
        return F.timestamp_micros(F.unix_date(first).cast("long") * F.lit(DAY_MICROS))
    return F.timestamp_micros(bucket_micros(F.unix_micros(ts), width))


def utc_date(ts):
    """Calendar day in UTC, whatever the session time zone is."""
    return F.date_from_unix_date(day_number(F.unix_micros(ts)))


def day_number(micros):
    """UTC days since 1970 of an instant in microseconds."""
    midnight = micros - F.pmod(micros, F.lit(DAY_MICROS))
    return (midnight / F.lit(DAY_MICROS)).cast("int")


def day_start(day):
    """UTC midnight at which a calendar day begins."""
    return F.timestamp_micros(F.unix_date(day).cast("long") * F.lit(DAY_MICROS))


def in_range(df, low, high, low_open=False, high_open=False, ts="timestamp"):
    """Predicate ``low <= ts <= high``; also on the ``date`` partition column if there is one."""
    at = F.col(ts)
    low_ok = (at > low) if low_open else (at >= low)
    high_ok = (at < high) if high_open else (at <= high)
    found = low_ok & high_ok
    if "date" in df.columns:
        found = found & F.col("date").between(utc_date(low), utc_date(high))
    return found


def truncate_millis(ts):
    """``ts`` at the millisecond precision readings are stored with."""
    return F.timestamp_millis(F.unix_millis(ts))


def format_utc(ts):
    """Text form ``YYYY-MM-DD HH:MM:SS.mmm+00`` of an instant."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+00"))


def period_seconds(period):
    """Seconds of a poll period such as ``20s 1m 1h 1d``; NULL if malformed or outside 5 s … 1 day."""
    number = F.regexp_extract(period, r"^(\d+)[smhd]$", 1).try_cast("bigint")
    unit = F.regexp_extract(period, r"^\d+([smhd])$", 1)
    factor = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400)
    )
    # A number beyond 86,400 is out of range in every unit; testing it first avoids overflow.
    seconds = F.when(number <= 86_400, number * factor)
    return F.when(seconds.between(5, 86_400), seconds)
