"""Tariff zones."""

from pyspark.sql import functions as F

# The night zone runs from 23:00 to 07:00.
NIGHT_START = 23
NIGHT_END = 7


def tariff_zone(ts, tz="UTC", night_start=NIGHT_START, night_end=NIGHT_END):
    """``'night'`` or ``'day'`` by the hour of ``ts`` in zone ``tz``."""
    local = F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))
    hour = F.hour(local)
    return F.when((hour >= night_start) | (hour < night_end), "night").otherwise("day")
