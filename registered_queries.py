"""The registered queries: each maps the given tables to the engine's inputs and runs an operator."""

import os

from pyspark.sql import functions as F

from wattline.catalog import MINUTE_REGISTERS, TARIFF_REGISTERS
from wattline.functions.decode import adjusted_address, precision_first
from wattline.functions.naming import column_name
from wattline.functions.tariff import tariff_zone
from wattline.functions.time import bucket, format_utc, period_seconds
from wattline.operators.changes import change_filter, constant_registers, deadband_heartbeat
from wattline.operators.frames import (
    decode_frames, decode_with_context, decode_with_memory, enabled_registers, frame_sizes, overhanging_registers,
    plan_frames, registers_in_ranges, resolve_addresses,
)
from wattline.operators.latest import last_known, last_value_at, period_diff
from wattline.operators.quality import (
    as_spark_type, cast_wide, catalog_types, range_overlaps, rejected_values, stored_drift, wide_columns,
)
from wattline.operators.refresh import (
    DAY_OFFSETS, MINUTE_OFFSETS, refresh_table, refresh_touched, refresh_window,
)
from wattline.operators.series import period_avg, period_values
from wattline.operators.snapshot import param_history, snapshot
from wattline.operators.stats import (
    bucket_stats, tariff_report, tariff_report_sum, tariff_stats, with_price,
)
from wattline.plans.reports import daily_tariff_report, history, ingest_frames, period_report
from wattline.session import scratch_path
from wattline.sources.catalog import parse_catalog
from wattline.sources.telemetry import (
    append_telemetry, distinct_registers, read_staging, read_telemetry, row_count, write_staging,
)
from wattline.sources.wide import (
    export_headers, import_long, missing_columns, read_export_lines, read_wide_exports, unpivot_rows,
    unpivot_table, wide_rows, write_exports, write_workbooks,
)
from wattline.streaming.jobs import (
    run_available, stream_bucket_stats, stream_deadband, stream_decode, stream_dedup, stream_ingest, stream_snapshot,
    stream_tariff_stats, stream_to_table, upsert_batches,
)

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FIELDS = ["view", "click", "none", "error", "signup", "purchase"]
AT = "2024-01-11 12:34:56"
START, FINISH = "2024-01-10 00:00:00", "2024-01-12 00:00:00"
NOON = "2024-01-10 12:00:00"
MONTH_START, MONTH_END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
NAMES = MINUTE_REGISTERS + ["heatSinkTemp(C)", "pf(NA)", "unlisted(NA)"]

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
LINES = """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,
    l_extendedprice double, l_discount double, l_tax double, l_returnflag string,
    l_shipdate timestamp"""

# The same with one register for each address, as a map by address has it.
CONTEXT_REGISTERS = """VALUES (500, 'r_u16', 'uint16', 1.0, false, true, 0),
    (501, 'r_i16', 'int16', 0.25, false, true, 4), (502, 'r_u64', 'uint64', 1.0, false, true, 5),
    (503, 'r_digit', 'uint16', 1.0, true, true, 6), (504, 'r_off', 'uint16', 1.0, false, false, 8),
    (505, 'r_long', 'uint32', 1.0, false, true, 7), (600, 'r_far', 'uint16', 1.0, false, true, 9)"""
DIRECTORY = """VALUES ('click', 'Clicks', 'n'), ('view', 'Views', ''), ('error', NULL, 'n'),
    ('purchase', 'Purchases', NULL)"""
PRICES = """VALUES (TIMESTAMP '2024-01-05 00:00:00', 4.0, 2.0),
    (TIMESTAMP '2024-01-15 00:00:00', 5.0, 2.5), (TIMESTAMP '2024-01-24 18:00:00', 6.0, 3.0)"""
# address, name, type, scale, preprocessing, enabled, register_no
REGISTERS = """VALUES (500, 'r_u16', 'uint16', 1.0, false, true, 0),
    (500, 'r_u32', 'uint32', 1.0, false, true, 1), (500, 'r_i32', 'int32', 0.5, false, true, 2),
    (500, 'r_f32', 'float32', 1.0, false, true, 3), (501, 'r_i16', 'int16', 0.25, false, true, 4),
    (502, 'r_u64', 'uint64', 1.0, false, true, 5), (503, 'r_digit', 'uint16', 1.0, true, true, 6),
    (505, 'r_long', 'uint32', 1.0, false, true, 7), (504, 'r_off', 'uint16', 1.0, false, false, 8),
    (600, 'r_far', 'uint16', 1.0, false, true, 9)"""


def values(spark, rows, columns):
    return spark.sql(f"SELECT * FROM {rows} AS t({columns})")


# Inputs ---------------------------------------------------------------------------------------


def read(spark, sf, table, schema=None):
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(os.path.join(sf, f"{table}.parquet"))


def as_telemetry(events):
    return events.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 4 + 1).cast("int").alias("device_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("register_name"),
        "value",
    )


def gauges(spark, sf):
    """Events as readings of five registers."""
    return as_telemetry(read(spark, sf, "events", EVENTS))


def counters(spark, sf):
    """The same with a rising value."""
    return gauges(spark, sf).withColumn("value", F.col("id") * F.lit(0.5))


def steps(spark, sf):
    """The same with values that repeat."""
    return gauges(spark, sf).withColumn("value", F.floor(F.col("value") / 50) * F.lit(50.0))


def stream_gauges(spark, sf):
    events = (
        spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    return as_telemetry(events)


def named_gauges(spark, sf):
    """Events as readings of all snapshot registers."""
    names = F.array(*[F.lit(n) for n in NAMES])
    at = (F.col("id") % len(NAMES) + 1).cast("int")
    return gauges(spark, sf).withColumn("register_name", F.element_at(names, at))


def meter(spark, sf):
    """Order lines as readings of all registers, some NULL, over seven years."""
    names = F.array(*[F.lit(n) for n in NAMES])
    second = (F.col("l_orderkey") * 7919) % 86_400
    micros = F.unix_micros("l_shipdate") + second * 1_000_000 + F.col("l_linenumber") * 1000
    return read(spark, sf, "lineitem", LINES).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("device_id"),
        F.timestamp_micros(micros).alias("timestamp"),
        F.element_at(names, (F.col("l_partkey") % len(NAMES) + 1).cast("int")).alias("register_name"),
        F.when(F.col("l_tax") < 0.075, F.col("l_quantity") * 4).alias("value"),
    )


def as_frames(lines, number=None):
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber") if number is None else number
    price = F.floor("l_extendedprice")
    words = [
        (F.col("l_partkey") * 31) % 65_536, (F.col("l_orderkey") * 7919) % 65_536,
        F.floor("l_quantity"), price % 65_536, F.col("l_linenumber"), F.floor(price / 65_536),
    ]
    return lines.select(
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("device_id"),
        F.lit("holding").alias("reg_type"),
        F.col("l_shipdate").alias("ts"),
        F.lit(500).alias("start"),
        F.array(*[w.cast("int") for w in words]).alias("words"),
        number.alias("frame_id"),
    )


def frames(spark, sf):
    return as_frames(read(spark, sf, "lineitem", LINES))


def stream_frames(spark, sf):
    lines = spark.readStream.schema(LINES).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    return as_frames(lines)


def frame_catalog(spark, registers=None):
    columns = "address, name, type, scale, preprocessing, enabled, register_no"
    return values(spark, registers or REGISTERS, columns).select(
        F.explode(F.sequence(F.lit(1), F.lit(4))).alias("device_id"),
        F.lit("holding").alias("reg_type"), "address", "name", "type",
        F.col("scale").cast("double").alias("scale"), "preprocessing", "enabled", "register_no",
    )


def part_registers(spark, sf):
    """Parts as the registers of many devices, forty each."""
    types = F.array(*[F.lit(t) for t in ["int16", "uint16", "int32", "uint32", "float32", "uint64"]])
    spaces = F.array(F.lit("holding"), F.lit("input"))
    key = F.col("p_partkey")
    return read(spark, sf, "part").select(
        F.floor(key / 40).cast("int").alias("device_id"),
        (key % 40).cast("int").alias("register_no"),
        ((key * 37) % 500).cast("int").alias("address"),
        F.concat(F.col("p_brand"), F.lit("-"), key.cast("string")).alias("name"),
        F.element_at(types, (F.col("p_size") % 6 + 1).cast("int")).alias("type"),
        F.element_at(spaces, (key % 2 + 1).cast("int")).alias("reg_type"),
        F.when(F.col("p_size") % 3 == 0, F.lit(0.1)).otherwise(F.lit(1.0)).alias("scale"),
        (key % 11 != 0).alias("enabled"),
    )


def part_devices(spark, sf):
    keys = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("id"))
    return keys.distinct().select(
        "id", (F.col("id") % 3 != 0).alias("is_zero"), (F.col("id") % 5 != 0).alias("enabled")
    )


def part_ranges(spark, sf):
    key = F.col("p_partkey")
    return read(spark, sf, "part").select(
        F.floor(key / 20).cast("int").alias("device_id"),
        key.alias("range_no"),
        ((key * 37) % 1000).cast("int").alias("start"),
        (F.col("p_size") - 1).cast("int").alias("count"),
        F.lit("20s").alias("period"),
        F.lit("holding").alias("reg_type"),
    )


def configs(spark, sf):
    """Parts as JSON configurations, one device each, some keys missing or invalid."""
    key = F.col("p_partkey")
    register = F.struct(
        F.when(key % 13 != 0, (key * 37) % 500).alias("address"),
        F.col("p_name").alias("name"),
        F.when(key % 17 == 0, F.lit("int8")).otherwise(F.lit("uint16")).alias("type"),
        F.when(key % 3 == 0, F.lit("input")).alias("regType"),
        F.when(key % 4 == 0, F.lit(0.1)).alias("scale"),
        F.when(key % 5 == 0, F.lit(True)).alias("preprocessing"),
        F.when(key % 7 == 0, F.lit(False)).alias("enabled"),
    )
    number = F.floor(key / 40)
    devices = read(spark, sf, "part").groupBy(number.alias("id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(key.alias("k"), register.alias("r")))), lambda x: x["r"]
        ).alias("registers")
    )
    period = F.when(F.col("id") % 6 == 0, F.lit("2s")).otherwise(F.lit("1m"))
    device = F.struct(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(False)).alias("isZero"),
        F.struct(
            F.lit("/dev/tty0").alias("port"), F.lit(9600).alias("baud_rate"),
            F.when(F.col("id") % 10 == 0, F.lit("X")).otherwise(F.lit("n")).alias("parity"),
            F.lit(8).alias("data_bits"), F.lit(1).alias("stop_bits"),
        ).alias("connection"),
        "registers",
        F.array(F.struct(
            (F.col("id") % 500).alias("start"), F.lit(100).alias("count"), period.alias("period")
        )).alias("ranges"),
    )
    return devices.select(
        F.col("id").cast("string").alias("source"),
        F.to_json(F.struct(F.array(device).alias("devices"))).alias("json"),
    )


def exports(spark, sf, file="l_suppkey"):
    """Order lines as wide rows, one file per supplier."""
    return read(spark, sf, "lineitem", LINES).select(
        F.col(file).cast("string").alias("file"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("line_no"),
        F.when(F.col("l_quantity") > 2, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit(" ")).alias("Time"),
        F.col("l_quantity").alias("quantity(n)/101"),
        F.col("l_discount").alias("discount(%)/102-103"),
        F.col("l_tax").cast("string").alias("tax(℃)/104"),
        F.col("l_returnflag").alias("flag(NA)/105"),
    )


KNOWN = ["quantity(n)", "discount(%)", "tax(C)", "flag(NA)", "pf(NA)"]


def directory(spark):
    return values(spark, DIRECTORY, "register_name, ua_friendly_name, unit")


def prices(spark):
    return values(spark, PRICES, "dt, dprice, nprice").select(
        "dt", F.col("dprice").cast("double").alias("dprice"), F.col("nprice").cast("double").alias("nprice")
    )


def order_prices(spark, sf):
    """Orders as price changes, the newest of each time being the dearest."""
    orders = read(spark, sf, "orders", "o_orderdate timestamp, o_totalprice double")
    return orders.groupBy(F.timestamp_micros(
        F.unix_micros("o_orderdate") + F.pmod(F.floor("o_totalprice"), F.lit(86_400)) * 1_000_000
    ).alias("dt")).agg(F.max("o_totalprice").alias("dprice"), F.min("o_totalprice").alias("nprice"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 8) for c in columns})


# Queries --------------------------------------------------------------------------------------


def q_append(spark, sf):
    path = scratch_path(spark, "append")
    rows = gauges(spark, sf)
    append_telemetry(spark, rows.filter("timestamp < '2024-01-20'"), path)
    append_telemetry(spark, rows.filter("timestamp >= '2024-01-10'"), path)
    return read_telemetry(spark, path).drop("date")


def export_lines(spark, sf):
    """The same exports as CSV files, one for each supplier; the title and header lines come first in a file."""
    path = scratch_path(spark, "exports")
    columns = ["Time", "quantity(n)/101", "discount(%)/102-103", "tax(℃)/104", "flag(NA)/105"]
    text = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in columns])
    lines = exports(spark, sf).select(F.col("file").alias("supplier"), text.alias("value"))
    titles = ["Report,,,,", ",,,,", ",".join(columns)]
    write_exports(lines, path, "supplier", "value", titles).write.parquet(path + "-written")
    return by_supplier(read_export_lines(spark, path))


def by_supplier(lines):
    """The supplier in its name stands for the file."""
    return lines.withColumn("file", F.regexp_extract("file", "supplier=([0-9]+)", 1))


def q_export_files(spark, sf):
    lines = export_lines(spark, sf)
    return unpivot_rows(wide_rows(lines, export_headers(lines)), KNOWN).select(
        "file", "Time", "register_name", "value")


def q_workbooks(spark, sf):
    """Order lines as workbooks of 20,000 order numbers each, every other one with days since 1904."""
    path = scratch_path(spark, "workbooks")
    second = F.make_dt_interval(secs=((F.col("l_orderkey") * 7919) % 86_400).cast("decimal(18,6)"))
    rows = read(spark, sf, "lineitem", LINES).withColumn("book", F.floor(F.col("l_orderkey") / 20_000))
    time = F.when(F.col("l_quantity") > 2, F.col("l_shipdate") + second)
    cells = {
        "quantity(n)/101": F.col("l_quantity"), "discount(%)/102-103": F.col("l_discount"),
        "tax(℃)/104": F.col("l_tax"), "flag(NA)/105": F.col("l_returnflag"),
    }
    write_workbooks(rows, path, "book", time, cells, F.col("book") % 2 == 1).write.parquet(path + "-written")
    long = unpivot_rows(read_wide_exports(spark, path, xlsx=True), KNOWN)
    book = F.regexp_extract("file", r"([0-9]+)\.xlsx$", 1).alias("book")
    return long.select(book, "timestamp", "register_name", "value")


def q_missing(spark, sf):
    return missing_columns(export_headers(export_lines(spark, sf)), KNOWN)


def q_staging(spark, sf):
    path = scratch_path(spark, "staging")
    write_staging(exports_long(spark, sf), path)
    return row_count(read_staging(spark, path))


def q_staging_replaced(spark, sf):
    """A second load, of every other line, takes the place of the first."""
    path = scratch_path(spark, "staging")
    rows = exports(spark, sf)
    write_staging(import_long(unpivot_table(rows, KNOWN, previous=True)), path)
    write_staging(import_long(unpivot_table(rows.filter("line_no % 2 = 0"), KNOWN, previous=True)), path)
    return read_staging(spark, path).select("device_id", "timestamp", "register_name", "value")


# Registers of the wide table: what order lines are measured in, as a device's registers.
WIDE_REGISTERS = """VALUES (1, 'quantity(n)', 'int16', 1.0, true), (2, 'price(x)', 'uint16', 0.1, true),
    (3, 'part', 'int32', 1.0, true), (4, 'order', 'uint64', 1.0, true), (5, 'tax(%)', 'float32', 1.0, true),
    (6, 'total', 'uint32', 0.1, true), (7, 'off', 'int16', 1.0, false)"""


def wide_lines(spark, sf):
    """Order lines as a wide table whose columns are doubles, some too large for their register."""
    return read(spark, sf, "lineitem", LINES).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), (F.col("l_partkey") * F.lit(1e8)).alias("part"),
        (F.col("l_orderkey") * F.lit(1e15)).alias("order"),
        F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("tax"),
        (F.col("l_suppkey") * F.lit(25e6)).alias("total"), F.col("l_discount").alias("off"),
    )


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def wide_types(spark):
    return catalog_types(values(spark, WIDE_REGISTERS, "register_no, name, type, scale, enabled").withColumn(
        "scale", F.col("scale").cast("double")))


def q_wide_schema(spark, sf):
    typed = cast_wide(wide_lines(spark, sf), wide_types(spark))
    names = {f.name: f.dataType.simpleString() for f in typed.schema if f.name not in LINE_KEYS}
    return typed.select(*LINE_KEYS, *[F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c)
                                      for c, t in names.items()])


def q_wide_rejects(spark, sf):
    return rejected_values(wide_lines(spark, sf), wide_types(spark), LINE_KEYS).withColumn(
        "value", F.col("value").cast("double"))


def q_schema_drift(spark, sf):
    """Wide tables of three ages, a folder for each month: floats first, then without a column, then as
    the catalog has it."""
    path = scratch_path(spark, "ages")
    types = wide_types(spark)
    rows = read(spark, sf, "lineitem", LINES).select(*LINE_KEYS, F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    rows = wide_lines(spark, sf).join(rows, LINE_KEYS)
    first, second, third = (
        rows.filter("month < '1997'"), rows.filter("month >= '1997' AND month < '1999'").drop("price"),
        rows.filter("month >= '1999'"))
    for age in (first, cast_wide(second, types), cast_wide(third, types)):
        age.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)
    expected = {column_name(register): as_spark_type(t) for register, t in types.items()}
    month = F.regexp_extract("file", "month=([0-9-]+)", 1).alias("month")
    return stored_drift(spark, path, expected).select(month, "column_name", "current_type", "expected_type").distinct()


def exports_long(spark, sf):
    return import_long(unpivot_table(exports(spark, sf), KNOWN, previous=True))


def q_refresh(spark, sf):
    path = scratch_path(spark, "refresh")
    rows = counters(spark, sf)

    def build(telemetry):
        return tariff_stats(telemetry, EVENT_TYPES)

    everything = refresh_window("2024-03-01", ("90 days", None), "1 day")
    refresh_table(spark, rows.filter("register_name <> 'error'"), build, path, everything, "day")
    window = refresh_window("2024-01-25 06:00:00", DAY_OFFSETS, "1 day")
    refresh_table(spark, rows, build, path, window, "day")
    return spark.read.parquet(path).drop("date")


def q_lost_days(spark, sf):
    """Two days lose all their rows before the second refresh."""
    path = scratch_path(spark, "refresh-lost")
    rows = counters(spark, sf)
    window = refresh_window("2024-03-01", ("90 days", None), "1 day")
    lost = F.to_date("timestamp").isin("2024-01-14", "2024-01-15")
    for telemetry in (rows, rows.filter(~lost)):
        refresh_table(spark, telemetry, lambda t: tariff_stats(t, EVENT_TYPES), path, window, "day")
    return spark.read.parquet(path).drop("date")


def refreshed_twice(spark, rows, build, name, time, offsets, width):
    """An aggregate table of all rows, refreshed once more at a later time."""
    path = scratch_path(spark, name)
    everything = refresh_window("2024-03-01", ("90 days", None), width)
    refresh_table(spark, rows.filter("value >= 5"), build, path, everything, time)
    refresh_table(spark, rows, build, path, everything, time)
    refresh_table(spark, rows, build, path, refresh_window("2024-01-25 06:00:30", offsets, width), time)
    return spark.read.parquet(path).drop("date")


def q_touched(spark, sf):
    """Rows of the first days come sixty days after the others; only their days are rebuilt."""
    path = scratch_path(spark, "touched")
    rows = named_gauges(spark, sf)
    late = (F.col("id") % 7 == 0) & (F.col("timestamp") < "2024-01-04")
    for part in (rows.filter(~late), rows.filter(late)):
        append_telemetry(spark, part, f"{path}/telemetry", f"{path}/log")
        refresh_touched(spark, f"{path}/telemetry", bucket_stats, f"{path}/stats", f"{path}/log", "1 day", "metricts")
    return rounded_stats(spark.read.parquet(f"{path}/stats").drop("date"))


def q_stream_stats(spark, sf):
    """Readings come in three files, the last with late ones of every day."""
    path = scratch_path(spark, "stream-stats")
    rows = named_gauges(spark, sf)
    late, second = F.col("id") % 5 == 0, F.col("timestamp") >= "2024-01-16"
    for part in (rows.filter(~late & ~second), rows.filter(~late & second), rows.filter(late)):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return rounded_stats(stream_bucket_stats(spark, stream, f"{path}/states", f"{path}/checkpoint"))


def q_default_rule(spark, sf):
    """Registers at the address of the built-in rule, on its device and on others."""
    read_at_540 = frames(spark, sf).withColumns({
        "start": F.lit(540), "words": F.array((F.element_at("words", 5) * 2253 + 4).cast("int")),
    })
    catalog = values(spark, "VALUES (1), (2), (3), (4)", "device_id").select(
        "device_id", F.lit("holding").alias("reg_type"), F.lit(540).alias("address"), F.lit("digit").alias("name"),
        F.lit("uint16").alias("type"), F.lit(1.0).cast("double").alias("scale"), F.lit(True).alias("preprocessing"),
        F.lit(True).alias("enabled"), F.lit(0).alias("register_no"),
    )
    return decode_frames(read_at_540, catalog).select(
        "frame_id", "device_id", "ts", "name", F.round("value", 10).alias("value"))


def q_stream_tariff(spark, sf):
    path = scratch_path(spark, "stream-tariff")
    keys = ["day", "device_id", "register_name", "zone"]
    stream = stream_tariff_stats(
        stream_gauges(spark, sf).withColumn("value", F.col("id") * F.lit(0.5)), EVENT_TYPES
    )
    run_available(
        stream, None, f"{path}-checkpoint", "update", upsert_batches(spark, path, keys, "day")
    )
    return spark.read.parquet(path).drop("date")


def q_precision(spark, sf):
    return read(spark, sf, "lineitem", LINES).select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.round(precision_first(F.col("l_extendedprice")), 10).alias("v"),
        F.round(precision_first(F.col("l_discount")), 10).alias("w"),
    )


def digit_503(device_id, address, value):
    return F.when(address == 503, F.round(precision_first(value), 10)).otherwise(value)


def share_of_pair(address, value, found):
    """A hook that needs another register of the frame: the share of register 501 in it."""
    return F.round(value / (F.abs(found[501]) + 1), 8)


def q_decode(spark, sf):
    decoded = decode_frames(frames(spark, sf), frame_catalog(spark), preprocess=digit_503)
    return decoded.select(
        "frame_id", "device_id", "ts", "address", "name", "type", "raw_value", "value"
    )


def q_context(spark, sf):
    return decode_with_context(frames(spark, sf), frame_catalog(spark, CONTEXT_REGISTERS), share_of_pair).select("frame_id", "device_id", "ts", "address", "name", "value")


def q_memory(spark, sf):
    """Every third frame starts behind register 501, whose last value the hook takes from a frame before."""
    late = F.col("frame_id") % 3 == 0
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")
    whole = as_frames(read(spark, sf, "lineitem", LINES), number)
    cut = whole.withColumns({
        "start": F.when(late, 503).otherwise(F.col("start")),
        "words": F.when(late, F.slice("words", 4, 3)).otherwise(F.col("words")),
    })
    return decode_with_memory(cut, frame_catalog(spark, CONTEXT_REGISTERS), share_of_pair, [501]).select(
        "frame_id", "device_id", "ts", "address", "name", "value")


def q_overhanging(spark, sf):
    return overhanging_registers(frames(spark, sf), frame_catalog(spark)).select(
        "frame_id", "device_id", "ts", "address", "name"
    )


def q_stream_decode(spark, sf):
    stream = stream_decode(stream_frames(spark, sf), frame_catalog(spark), preprocess=digit_503)
    return stream_to_table(spark, stream, "stream-decode").drop("id")


# When the ingest starts for the second time.
SECOND_START = "2024-01-22 00:00:00"


def spread(frames):
    """Frames over the seconds of their day; some share their device and time."""
    second = F.col("frame_id") * 7919 % 86_400
    return frames.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + second * 1_000_000))


def q_ingest(spark, sf):
    return ingest_frames(spread(frames(spark, sf)), frame_catalog(spark), "10 minutes")


def q_stream_ingest(spark, sf):
    path = scratch_path(spark, "stream-ingest")
    stream_ingest(
        spark, spread(stream_frames(spark, sf)), frame_catalog(spark), path, f"{path}-checkpoint", "10 minutes")
    return read_telemetry(spark, path).drop("date")


def within_weeks(frames):
    """Frames of seven years within six weeks, a day in 24 minutes."""
    days = F.datediff(F.to_date("ts"), F.lit("1992-01-01").cast("date"))
    millis = days.cast("long") * 1_440_000 + F.col("frame_id") * 7919 % 1_440_000
    return frames.withColumn("ts", F.timestamp_millis(F.lit(1_704_067_200_000) + millis))


def q_ingest_two_starts(spark, sf):
    """Two starts of the ingest, the second without the states of the first: it goes on from the table."""
    path = scratch_path(spark, "ingest-starts")
    recorded = within_weeks(frames(spark, sf)).withColumn("part", (F.col("ts") >= SECOND_START).cast("int"))
    recorded.write.partitionBy("part").parquet(f"{path}/frames")
    schema = recorded.drop("part").schema
    for part in (0, 1):
        stream = spark.readStream.schema(schema).parquet(f"{path}/frames/part={part}")
        stream_ingest(
            spark, stream, frame_catalog(spark), f"{path}/table", f"{path}/checkpoint-{part}", "10 minutes", "sink")
    return read_telemetry(spark, f"{path}/table").drop("date")


def q_resolve(spark, sf):
    key = F.col("p_partkey")
    address = ((key * 37) % 500).cast("string")
    later = ((key * 37) % 500 + 4).cast("string")
    spec = (
        F.when(key % 5 == 0, F.concat(address, F.lit("-"), later))
        .when(key % 5 == 1, F.concat(address, F.lit(", x,"), later))
        .when(key % 5 == 2, F.concat(later, F.lit("-"), address))
        .when(key % 5 == 3, F.concat(F.lit("  "), address, F.lit(" V")))
        .otherwise(F.lit("none"))
    )
    specs = read(spark, sf, "part").select(
        F.floor(key / 40).cast("int").alias("device_id"), key.alias("spec_no"), spec.alias("spec")
    )
    found = resolve_addresses(specs, part_registers(spark, sf))
    return found.select("device_id", "spec_no", "pos", "address", "register_no", "name")


def q_catalog(spark, sf):
    registers = parse_catalog(configs(spark, sf)).registers
    return registers.select(
        "device_id", "register_no", "address", "name", "type", "reg_type", "scale",
        "preprocessing", "enabled",
    )


def q_rejects(spark, sf):
    return parse_catalog(configs(spark, sf)).rejects


def q_enabled(spark, sf):
    return enabled_registers(part_registers(spark, sf), part_devices(spark, sf), explicit=[0, 5])


def q_in_ranges(spark, sf):
    """Registers of a device with the ranges of the same device that read them."""
    return registers_in_ranges(part_registers(spark, sf), part_ranges(spark, sf)).select(
        "device_id", "register_no", "address", "range_no", "start", "count"
    )


def q_addresses(spark, sf):
    flags = part_devices(spark, sf).select(F.col("id").alias("device_id"), "is_zero")
    return part_registers(spark, sf).join(flags, "device_id").select(
        "device_id", "register_no", "address",
        adjusted_address(F.col("address"), F.col("is_zero")).alias("wire_address"),
    )


def q_periods(spark, sf):
    unit = F.substring(F.lit("smhdx"), (F.col("l_orderkey") % 5 + 1).cast("int"), F.lit(1))
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), unit)
    return read(spark, sf, "lineitem", LINES).groupBy(text.alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("seconds", period_seconds(F.col("period")))


def q_buckets(spark, sf):
    ts = F.col("timestamp")
    return gauges(spark, sf).groupBy(
        bucket(ts, "7 days").alias("week"), bucket(ts, "5 hours").alias("hours"),
        bucket(ts, "1 month").alias("month"),
    ).agg(F.count(F.lit(1)).alias("n"))


def q_zones(spark, sf):
    ts = F.col("timestamp")
    return gauges(spark, sf).select(
        "id", tariff_zone(ts).alias("zone"), tariff_zone(ts, "Europe/Kyiv").alias("zone_local"),
        format_utc(ts).alias("stored_as"),
    )


def q_price(spark, sf):
    days = gauges(spark, sf).select(F.to_date("timestamp").alias("day"))
    lines = read(spark, sf, "lineitem", "l_shipdate timestamp").select(F.to_date("l_shipdate").alias("day"))
    return with_price(days.union(lines).distinct(), order_prices(spark, sf))


def history_of(spark, sf, fill, by_device=False):
    snapshots = snapshot(named_gauges(spark, sf), by_device=by_device)
    return param_history(snapshots, MONTH_START, MONTH_END, fill, by_device)


def q_constants(spark, sf):
    """Orders as files, so that some have one line only or repeat a value."""
    orders = exports(spark, sf, "l_orderkey")
    return constant_registers(unpivot_table(orders, KNOWN).filter("value is not null"), order="Time")


QUERIES = {
    "last_value_at": lambda s, d: last_value_at(gauges(s, d), AT, FIELDS),
    "last_value_at_friendly": lambda s, d: last_value_at(
        gauges(s, d), AT, FIELDS, directory(s), friendly_name=True, sort=False, add_unit=True
    ),
    "last_known": lambda s, d: last_known(meter(s, d)),
    "last_known_device": lambda s, d: last_known(meter(s, d), 2),
    "distinct_registers": lambda s, d: distinct_registers(meter(s, d)),
    "row_count": lambda s, d: row_count(meter(s, d)),
    "period_diff": lambda s, d: period_diff(counters(s, d), START, FINISH, FIELDS),
    "period_diff_friendly": lambda s, d: period_diff(
        counters(s, d), START, FINISH, FIELDS, directory(s), friendly_name=True, add_unit=True
    ),
    "period_values": lambda s, d: rounded(
        period_values(gauges(s, d), START, FINISH, "5 hours", FIELDS), "value"
    ),
    "period_values_hourly": lambda s, d: rounded(
        period_values(gauges(s, d), MONTH_START, MONTH_END, "1 hour", FIELDS, directory(s), True), "value"
    ),
    "period_values_second": lambda s, d: rounded(
        period_values(gauges(s, d), START, NOON, "1 second", FIELDS), "value"
    ),
    "period_values_meter": lambda s, d: rounded(period_values(
        meter(s, d), "1996-01-01 00:00:00", "1997-01-01 00:00:00", "1 day", TARIFF_REGISTERS), "value"),
    "period_avg": lambda s, d: rounded(period_avg(gauges(s, d), "1 day"), "value"),
    "time_bucket": q_buckets,
    "tariff_zone": q_zones,
    "tariff_stats": lambda s, d: tariff_stats(counters(s, d), EVENT_TYPES),
    "tariff_stats_meter": lambda s, d: tariff_stats(meter(s, d)),
    "tariff_report": lambda s, d: daily_tariff_report(counters(s, d), prices(s), EVENT_TYPES),
    "tariff_report_meter": lambda s, d: tariff_report(tariff_stats(meter(s, d)), order_prices(s, d)),
    "tariff_report_sum": lambda s, d: tariff_report_sum(tariff_stats(counters(s, d), EVENT_TYPES)),
    "price_asof": q_price,
    "snapshot_1m": lambda s, d: snapshot(meter(s, d)),
    "snapshot_1d": lambda s, d: snapshot(meter(s, d), "1 day"),
    "snapshot_by_device": lambda s, d: snapshot(named_gauges(s, d), by_device=True),
    "param_history": lambda s, d: history_of(s, d, "previous_row"),
    "param_history_locf": lambda s, d: history_of(s, d, "locf"),
    "param_history_by_device": lambda s, d: history_of(s, d, "previous_row", True),
    "period_stat": lambda s, d: period_report(meter(s, d), "1995-01-01", "2002-01-01"),
    "period_report": lambda s, d: rounded_stats(period_report(named_gauges(s, d), START, FINISH)),
    "history_by_device": lambda s, d: history(named_gauges(s, d), START, FINISH, by_device=True),
    "period_report_by_device": lambda s, d: rounded_stats(
        period_report(named_gauges(s, d), START, FINISH, by_device=True)),
    "bucket_stats_1d": lambda s, d: bucket_stats(meter(s, d)),
    "bucket_stats_1h": lambda s, d: rounded_stats(bucket_stats(named_gauges(s, d), "1 hour")),
    "decode_frames": q_decode,
    "decode_with_context": q_context,
    "decode_with_memory": q_memory,
    "overhanging_registers": q_overhanging,
    "precision_first": q_precision,
    "adjusted_address": q_addresses,
    "ingest_frames": q_ingest,
    "stream_ingest": q_stream_ingest,
    "ingest_two_starts": q_ingest_two_starts,
    "range_overlaps": lambda s, d: range_overlaps(part_ranges(s, d)).select(
        "device_id", "range_no", "start", "stop"
    ),
    "registers_in_ranges": q_in_ranges,
    "enabled_registers": q_enabled,
    "plan_frames": lambda s, d: plan_frames(part_registers(s, d), part_devices(s, d)).select(
        "device_id", "reg_type", "register_no", "wire_address", "words", "frame_no", "frame_start"
    ),
    "frame_sizes": lambda s, d: frame_sizes(plan_frames(part_registers(s, d), part_devices(s, d))),
    "resolve_addresses": q_resolve,
    "parse_catalog": q_catalog,
    "catalog_rejects": q_rejects,
    "column_types": lambda s, d: wide_columns(part_registers(s, d)).select(
        "device_id", "register_no", "type", "scale", "column_type"
    ),
    "period_seconds": q_periods,
    "deadband_heartbeat": lambda s, d: deadband_heartbeat(steps(s, d), "5 minutes"),
    "deadband_wide": lambda s, d: deadband_heartbeat(gauges(s, d), "5 minutes", eps=25.0),
    "change_filter": lambda s, d: change_filter(steps(s, d), ["device_id", "register_name"]),
    "wide_import": lambda s, d: exports_long(s, d),
    "unpivot_clean": lambda s, d: unpivot_table(exports(s, d), KNOWN).drop("block", "timestamp"),
    "export_files": q_export_files,
    "workbooks": q_workbooks,
    "missing_columns": q_missing,
    "constant_registers": q_constants,
    "staging_count": q_staging,
    "staging_replaced": q_staging_replaced,
    "schema_drift": q_schema_drift,
    "wide_schema": q_wide_schema,
    "wide_rejects": q_wide_rejects,
    "append_dedup": q_append,
    "refresh_aggregate": q_refresh,
    "refresh_lost_day": q_lost_days,
    "refresh_touched": q_touched,
    "refresh_bucket_stats": lambda s, d: rounded_stats(refreshed_twice(
        s, named_gauges(s, d), bucket_stats, "refresh-stats", "metricts", DAY_OFFSETS, "1 day")),
    "refresh_snapshot": lambda s, d: refreshed_twice(
        s, named_gauges(s, d), snapshot, "refresh-snapshot", "minutets", MINUTE_OFFSETS, "1 minute"),
    "stream_snapshot_7m": lambda s, d: stream_to_table(
        s, stream_snapshot(stream_gauges(s, d), "7 minutes"), "stream-snapshot"
    ),
    "stream_snapshot_1h": lambda s, d: stream_to_table(
        s, stream_snapshot(stream_gauges(s, d), "1 hour"), "stream-snapshot"
    ),
    "decode_default_rule": q_default_rule,
    "stream_snapshot_1m": lambda s, d: stream_to_table(
        s, stream_snapshot(stream_gauges(s, d)), "stream-snapshot"
    ),
    "stream_deadband": lambda s, d: stream_to_table(
        s,
        stream_deadband(
            stream_gauges(s, d).withColumn("value", F.floor(F.col("value") / 50) * F.lit(50.0)),
            "5 minutes",
        ),
        "stream-deadband",
    ),
    "stream_decode": q_stream_decode,
    "stream_dedup": lambda s, d: stream_to_table(s, stream_dedup(stream_gauges(s, d)), "stream-dedup"),
    "stream_tariff_stats": q_stream_tariff,
    "stream_bucket_stats": q_stream_stats,
}


def rounded_stats(df):
    """Averages rounded, as the order of summing shows in their last digits."""
    return df.withColumns({c: F.round(c, 8) for c in df.columns if c.startswith("a_")})
