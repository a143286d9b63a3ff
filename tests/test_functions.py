import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattline.functions.decode import (
    adjusted_address, decode_words, has_wire_address, near, precision_first, raw_value, word_count,
)
from wattline.functions.naming import clean_header, column_name, display_name
from wattline.functions.tariff import tariff_zone
from wattline.functions.time import bucket, format_utc, period_seconds, truncate_millis, utc_date, width_micros


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def decode(spark, type_, words):
    value = decode_words(F.lit(type_), F.array(*[F.lit(w) for w in words]))
    return one(spark, value)


@pytest.mark.parametrize("type_, words, expected", [
    ("int16", [65535], -1.0),
    ("int16", [32767], 32767.0),
    ("uint16", [65535], 65535.0),
    ("int32", [0, 32768], -2147483648.0),
    ("int32", [65535, 65535], -1.0),
    ("uint32", [1, 1], 65537.0),
    ("uint32", [65535, 65535], 4294967295.0),
    ("uint64", [65535] * 4, 18446744073709551615.0),
    ("uint64", [1, 0, 0, 1], 281474976710657.0),
    ("float32", [0, 16928], 40.0),
    ("float32", [0, 16256], 1.0),
    ("float32", [0, 0], 0.0),
    ("float32", [1, 0], 1.401298464324817e-45),
    ("float32", [0, 32640], math.inf),
    ("float32", [0, 65408], -math.inf),
    ("int32", [5], 0.0),
    ("uint64", [1, 2, 3], 0.0),
    ("int16", [], 0.0),
])
def test_decode_words(spark, type_, words, expected):
    if not words:
        got = one(spark, decode_words(F.lit(type_), F.array().cast("array<int>")))
    else:
        got = decode(spark, type_, words)
    assert got == expected


def test_float32_nan_and_negative_zero(spark):
    assert math.isnan(decode(spark, "float32", [1, 32640]))
    assert math.copysign(1, decode(spark, "float32", [0, 32768])) == -1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False), min_size=1, max_size=50))
def test_float32_equals_ieee(spark, numbers):
    data = []
    for i, x in enumerate(numbers):
        bits = struct.unpack("<I", struct.pack("<f", x))[0]
        data.append((i, [bits & 0xFFFF, bits >> 16]))
    df = spark.createDataFrame(data, "i int, words array<int>")
    got = df.select("i", decode_words(F.lit("float32"), F.col("words")).alias("x")).collect()
    assert [r["x"] for r in sorted(got)] == numbers


@pytest.mark.parametrize("value, expected", [
    (2253.0, 2.53), (1254.0, 25.4), (5.0, 0.0), (10.0, 0.0), (-3.0, -3.0), (0.4, 0.4), (0.5, 0.0),
    (0.0, 0.0), (9876543.0, 876543e-9), (2252.5, 2.53),
])
def test_precision_first(spark, value, expected):
    assert one(spark, precision_first(F.lit(value))) == pytest.approx(expected, abs=1e-12)


def test_precision_first_of_infinity(spark):
    assert one(spark, precision_first(F.lit(math.inf))) == math.inf


def test_word_counts_and_raw_values(spark):
    counts = {t: one(spark, word_count(F.lit(t))) for t in ("int16", "uint32", "float32", "uint64")}
    assert counts == {"int16": 1, "uint32": 2, "float32": 2, "uint64": 4}
    assert one(spark, raw_value(F.lit(-2.9))) == -2
    assert one(spark, raw_value(F.lit(1.8e19))) is None


def test_addresses_count_from_one(spark):
    def wire(address, is_zero):
        return one(spark, adjusted_address(F.lit(address), F.lit(is_zero)))

    assert [wire(5, True), wire(5, False), wire(0, False)] == [5, 4, 0]
    valid = [one(spark, has_wire_address(F.lit(a), F.lit(z))) for a, z in ((0, True), (0, False), (1, False))]
    assert valid == [True, False, True]


def test_near(spark):
    assert one(spark, near(F.lit(1.0), F.lit(1.0 + 5e-10)))
    assert not one(spark, near(F.lit(1.0), F.lit(1.0 + 2e-9)))


@pytest.mark.parametrize("text, seconds", [
    ("5s", 5), ("20s", 20), ("1m", 60), ("1h", 3600), ("1d", 86400), ("24h", 86400), ("4s", None),
    ("2d", None), ("0s", None), ("1w", None), ("s", None), ("", None), (" 5s", None), ("1.5m", None),
    ("99999999999999999999s", None), ("007s", 7),
])
def test_period_seconds(spark, text, seconds):
    assert one(spark, period_seconds(F.lit(text))) == seconds


@pytest.mark.parametrize("text, width, expected", [
    ("2024-01-11 12:34:56.789", "1 minute", "2024-01-11 12:34:00"),
    ("2024-01-11 12:34:56", "1 day", "2024-01-11 00:00:00"),
    ("2024-01-11 12:34:56", "1 week", "2024-01-08 00:00:00"),
    ("1969-12-31 23:59:59", "1 day", "1969-12-31 00:00:00"),
    ("2024-01-11 12:34:56", "1 month", "2024-01-01 00:00:00"),
    ("2024-05-11 12:34:56", "3 months", "2024-04-01 00:00:00"),
    ("1999-12-31 12:00:00", "1 year", "1999-01-01 00:00:00"),
])
def test_bucket(spark, text, width, expected):
    assert str(one(spark, bucket(F.lit(text).cast("timestamp"), width))) == expected


def test_bad_width():
    for width in ("0 hours", "hour", "1 month", "1 fortnight"):
        with pytest.raises(ValueError):
            width_micros(width)


def test_day_of_the_last_microsecond(spark):
    for year in (1969, 2024, 2299):
        ts = F.lit(f"{year}-12-31 23:59:59.999999").cast("timestamp")
        assert str(one(spark, utc_date(ts))) == f"{year}-12-31"


def test_buckets_and_zones_do_not_follow_the_session_zone(spark):
    ts = F.lit("2024-01-11 23:30:00+00:00").cast("timestamp")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(
            F.unix_micros(bucket(ts, "1 day")).alias("day"), utc_date(ts).alias("date"),
            tariff_zone(ts).alias("zone"), tariff_zone(ts, "Asia/Tokyo").alias("tokyo"),
            format_utc(ts).alias("text"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["day"] == 1704931200000000 and str(row["date"]) == "2024-01-11"
    assert (row["zone"], row["tokyo"]) == ("night", "day")
    assert row["text"] == "2024-01-11 23:30:00.000+00"


@pytest.mark.parametrize("hour, zone", [(0, "night"), (6, "night"), (7, "day"), (22, "day"), (23, "night")])
def test_zone_hours(spark, hour, zone):
    assert one(spark, tariff_zone(F.lit(f"2024-01-11 {hour:02}:59:59").cast("timestamp"))) == zone


def test_millisecond_times(spark):
    ts = F.lit("2024-01-11 12:34:56.789987").cast("timestamp")
    assert str(one(spark, truncate_millis(ts))) == "2024-01-11 12:34:56.789000"
    assert one(spark, format_utc(ts)) == "2024-01-11 12:34:56.789+00"


def test_names(spark):
    assert column_name("Grid vac1(V)") == "grid_vac1"
    assert column_name("batteryEnergy(%)") == "batteryenergy"
    cleaned = {h: one(spark, clean_header(F.lit(h))) for h in (
        "batteryTemp(℃)/586", "totalUsed(kWh)/527-528", "a/12", "Time", "x/123/456",
    )}
    assert list(cleaned.values()) == ["batteryTemp(C)", "totalUsed(kWh)", "a/12", "Time", "x/123"]


@pytest.mark.parametrize("friendly, unit, flags, expected", [
    ("Nice", "n", (False, True), "raw"),
    ("Nice", "n", (True, False), "Nice"),
    ("Nice", "n", (True, True), "Nice (n)"),
    ("Nice", "", (True, True), "Nice"),
    ("Nice", None, (True, True), "Nice"),
    (None, "n", (True, True), "raw (n)"),
])
def test_display_name(spark, friendly, unit, flags, expected):
    null = F.lit(None).cast("string")
    name = display_name(
        F.lit("raw"), F.lit(friendly) if friendly else null, null if unit is None else F.lit(unit), *flags
    )
    assert one(spark, name) == expected
