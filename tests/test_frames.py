import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattline.operators.frames import (
    decode_frames, decode_with_context, decode_with_memory, enabled_registers, frame_sizes, frame_telemetry,
    overhanging_registers, parse_addresses, plan_frames, registers_in_ranges, resolve_addresses,
)
from wattline.operators.quality import (
    cast_wide, catalog_types, drift_report, range_overlaps, rejected_values, schema_drift, stored_columns,
    stored_drift, wide_columns,
)
from wattline.operators.snapshot import snapshot
from wattline.plans.reports import ingest_frames
from wattline.sources.catalog import parse_catalog, read_address_specs, read_register_catalog
from wattline.sources.telemetry import read_frames

REGISTER = """device_id int, register_no int, address int, name string, type string, reg_type string,
    scale double, preprocessing boolean, enabled boolean"""


def registers(spark, data):
    """Registers from rows (device, address, name, type) with optional further fields."""
    full = []
    for i, r in enumerate(data):
        extra = dict(zip(("reg_type", "scale", "preprocessing", "enabled"), ("holding", 1.0, False, True)))
        extra.update(r[4] if len(r) > 4 else {})
        full.append((r[0], i, *r[1:4], *extra.values()))
    return spark.createDataFrame(full, REGISTER)


def frames(spark, data):
    raw = spark.createDataFrame(data, "device_id int, reg_type string, ts string, start int, words array<int>")
    return raw.withColumn("ts", F.to_timestamp("ts"))


TS = "2024-01-10 10:00:00"


def test_decode_frames(spark):
    regs = registers(spark, [
        (1, 540, "temp", "uint16", {"preprocessing": True}), (1, 541, "volt", "uint16", {"scale": 0.01}),
        (1, 542, "long", "uint32"), (1, 544, "cut", "uint32"), (1, 541, "coil", "uint16", {"reg_type": "input"}),
        (1, 541, "off", "uint16", {"enabled": False}), (2, 540, "temp", "uint16", {"preprocessing": True}),
        (1, 539, "before", "uint16"), (1, 545, "after", "uint16"),
    ])
    f = frames(spark, [(1, "holding", TS, 540, [2253, 23012, 1, 1, 9]), (2, "holding", TS, 540, [2253])])
    got = {(r["device_id"], r["name"]): (r["value"], r["raw_value"]) for r in decode_frames(f, regs).collect()}
    assert got[(1, "temp")] == (pytest.approx(2.53), 2253)
    assert got[(1, "volt")] == (pytest.approx(230.12), 23012)
    assert got[(1, "long")] == (65537.0, 65537)
    assert got[(2, "temp")] == (2253.0, 2253)
    assert len(got) == 4
    assert [r["name"] for r in overhanging_registers(f, regs).collect()] == ["cut"]
    loose = decode_frames(f, regs, match_space=False)
    assert "coil" in {r["name"] for r in loose.collect()}
    long_form = frame_telemetry(decode_frames(f, regs))
    assert long_form.columns == ["id", "device_id", "timestamp", "register_name", "value"]


def test_hook_sees_the_other_values(spark):
    regs = registers(spark, [
        (1, 10, "total", "uint16", {"scale": 0.5}), (1, 11, "part", "uint16", {"preprocessing": True}),
        (1, 12, "cut", "uint32"),
    ])
    f = frames(spark, [(1, "holding", TS, 10, [100, 10, 7]), (1, "holding", TS, 11, [10])])
    got = decode_with_context(f, regs, lambda address, value, found: value / found[10])
    assert rows(got.select("start", "name", "value")) == [(10, "part", 0.2), (10, "total", 50.0), (11, "part", None)]


def test_hook_sees_values_of_earlier_frames(spark):
    regs = registers(spark, [
        (1, 10, "part", "uint16", {"preprocessing": True}), (1, 20, "total", "uint16", {"scale": 2.0}),
        (2, 10, "part", "uint16", {"preprocessing": True}), (1, 30, "level", "uint16", {"reg_type": "input"}),
    ])
    data = [
        (1, "holding", "2024-01-09 23:00:00", 10, [1]),  # nothing known yet
        (1, "holding", "2024-01-09 23:30:00", 20, [5]),
        (1, "input", "2024-01-09 23:40:00", 30, [7]),
        (1, "holding", "2024-01-12 00:00:00", 10, [2]),  # from three days before
        (1, "holding", "2024-01-12 01:00:00", 20, [9]),
        (1, "holding", "2024-01-12 02:00:00", 10, [3]),  # from the same day
        (1, "holding", "2024-01-14 02:00:00", 10, [4] + [0] * 9 + [50]),  # from the frame itself
        (2, "holding", "2024-01-14 03:00:00", 10, [6]),  # another device
    ]
    hook = lambda address, value, values: value * 1000 + values[20] + F.coalesce(values[30], F.lit(0.0)) / 10
    got = decode_with_memory(frames(spark, data), regs, hook, [30, 20])
    parts = got.filter("name = 'part'").orderBy("ts").select("value").collect()
    assert [x and round(x, 6) for (x,) in parts] == [None, 2010.7, 3018.7, 4100.7, None]
    assert rows(got.filter("name <> 'part'").select("name", "value")) == [
        ("level", 7.0), ("total", 10.0), ("total", 100.0), ("total", 18.0)]
    # Of frames of one time the number tells which comes first.
    ties = frames(spark, [(1, "holding", TS, 20, [n]) for n in (3, 1, 2)] + [(1, "holding", TS, 10, [5])])
    ties = ties.withColumn("frame_id", F.when(F.col("start") == 10, 9).otherwise(F.col("words")[0]))
    assert rows(decode_with_memory(ties, regs, hook, [20, 30]).filter("name = 'part'").select("value")) == [(5006.0,)]
    assert decode_with_memory(frames(spark, data).limit(0), regs, hook, [20, 30]).count() == 0
    assert decode_with_memory(frames(spark, data), regs, lambda a, v, m: v, []).count() == 9


def test_hot_device_frames_decode_whole_without_broadcast(spark):
    regs = registers(spark, [(d, a, f"r{a}", "uint16") for d in range(1, 4) for a in range(20)])
    hot = spark.range(3000).select(
        F.lit(1).alias("device_id"), F.lit("holding").alias("reg_type"),
        F.timestamp_seconds("id").alias("ts"), F.lit(0).alias("start"),
        F.array(*[(F.col("id") % 100 + i).cast("int") for i in range(10)]).alias("words"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert decode_frames(hot, regs).count() == 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ingest_frames(spark):
    regs = registers(spark, [(1, 10, "a", "uint16"), (1, 11, "b", "uint16")])
    data = [(1, "holding", f"2024-01-10 10:0{m}:{s}", 10, [1, m]) for m in range(3) for s in ("00", "20", "40")]
    got = ingest_frames(frames(spark, data), regs)
    assert rows(got.select("register_name", "value")) == [("a", 1.0), ("b", 0.0), ("b", 1.0), ("b", 2.0)]


def test_read_frames(spark, tmp_path):
    frames(spark, [(1, "holding", TS, 10, [1])]).write.parquet(str(tmp_path / "f"))
    assert read_frames(spark, str(tmp_path / "f")).first()["words"] == [1]


def test_plan_frames(spark):
    regs = registers(spark, [
        (1, 1, "a", "uint16"), (1, 99, "b", "uint32"), (1, 100, "c", "uint32"), (1, 0, "zero", "uint16"),
        (1, 5, "off", "uint16", {"enabled": False}), (1, 1, "in", "uint16", {"reg_type": "input"}),
        (2, 1, "a", "uint16"), (2, 100, "d", "uint16"), (2, 101, "e", "uint16"), (2, 101, "f", "uint16"),
    ])
    devices = spark.createDataFrame([(1, False), (2, True)], "id int, is_zero boolean")
    planned = plan_frames(regs, devices)
    got = {(r["device_id"], r["name"]): (r["wire_address"], r["frame_no"], r["frame_start"]) for r in planned.collect()}
    assert got == {
        (1, "zero"): (0, 0, 0), (1, "a"): (0, 0, 0), (1, "b"): (98, 0, 0), (1, "c"): (99, 1, 99),
        (1, "in"): (0, 0, 0),
        (2, "a"): (1, 0, 1), (2, "d"): (100, 0, 1), (2, "e"): (101, 1, 101), (2, "f"): (101, 1, 101),
    }
    sizes = {(r["device_id"], r["reg_type"], r["frame_no"]): r["total_words"] for r in frame_sizes(planned).collect()}
    assert sizes == {(1, "holding", 0): 100, (1, "holding", 1): 2, (1, "input", 0): 1, (2, "holding", 0): 100, (2, "holding", 1): 1}


@pytest.mark.parametrize("spec, expected", [
    ("5-8", [5, 6, 7, 8]), (" 7 ", [7]), ("3,1, 2", [3, 1, 2]), ("8-5", []), ("x", []), ("", []),
    ("1,x,,4", [1, 4]), ("1,2-4", [1, 2, 3, 4]), ("5-", []), ("-5", []), ("5-7-9", [5, 6, 7]),
    ("12abc", [12]), ("65536", [0]), ("65535-65535", [65535]), ("99999999999999999999", []),
    ("65534-65535", [65534, 65535]),
])
def test_address_specs(spark, spec, expected):
    df = spark.createDataFrame([(1, spec)], "device_id int, spec string")
    got = sorted((r["pos"], r["address"]) for r in parse_addresses(df).collect())
    assert [a for _, a in got] == expected


def test_address_spec_files(spark, tmp_path):
    (tmp_path / "specs.txt").write_text("5-6\n\n  9 \t\n7,8\n")
    specs = read_address_specs(spark, str(tmp_path / "specs.txt"))
    assert rows(specs) == [("5-6",), ("7,8",), ("9",)]


def test_resolve_takes_the_later_definition(spark):
    regs = registers(spark, [(1, 5, "old", "uint16"), (1, 5, "new", "uint16"), (1, 7, "x", "uint16"), (2, 6, "y", "uint16")])
    specs = spark.createDataFrame([(1, "7,5-9"), (1, "5-7"), (1, "7,6")], "device_id int, spec string")
    got = rows(resolve_addresses(specs, regs).select("spec", "pos", "address", "name"))
    assert got == [
        ("5-7", 0, 5, "new"), ("5-7", 2, 7, "x"), ("7,5-9", 0, 7, "x"), ("7,6", 0, 7, "x"),
    ]


def test_enabled_and_in_range(spark):
    regs = registers(spark, [
        (1, 5, "a", "uint16"), (1, 9, "far", "uint16"), (1, 6, "off", "uint16", {"enabled": False}), (2, 5, "b", "uint16"),
        (1, 5, "coil", "uint16", {"reg_type": "coil"}),
    ])
    devices = spark.createDataFrame([(1, True), (2, False)], "id int, enabled boolean")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(enabled_registers(regs, devices)) == ["a", "coil", "far"]
    assert names(enabled_registers(regs, devices, explicit=[2])) == ["a", "b", "coil", "far"]
    ranges = spark.createDataFrame(
        [(1, 5, 4, "20s", "holding")], "device_id int, start int, count int, period string, reg_type string"
    )
    assert names(registers_in_ranges(regs, ranges)) == ["a", "off"]
    assert names(registers_in_ranges(regs, ranges, match_space=False)) == ["a", "coil", "off"]


def test_range_overlaps_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    data = [(d, i, rng.randint(0, 60), rng.randint(0, 6)) for d in range(12) for i in range(8)]
    data += [(99, 0, 10, 0), (99, 1, 10, 5), (99, 2, 15, 0), (98, 0, 10, 5), (98, 1, 12, 0), (97, 0, 3, 2), (97, 1, 3, 2)]
    ranges = spark.createDataFrame(data, "device_id int, range_no int, start int, count int")
    want = {
        (d, i) for d, i, s, c in data for e, j, t, k in data
        if d == e and i != j and not (s + c <= t or t + k <= s)
    }
    got = range_overlaps(ranges).collect()
    assert {(r["device_id"], r["range_no"]) for r in got} == want and len(got) == len(want)
    assert (99, 0) not in want and (98, 1) in want


CONFIG = {
    "devices": [
        {
            "id": 1, "connection": {"port": "/dev/x", "baud_rate": 9600, "parity": "n", "data_bits": 8, "stop_bits": 1},
            "registers": [
                {"address": 100, "name": "a", "type": "int16"},
                {"address": 101, "name": "b", "type": "uint64", "regType": "input", "scale": 0.1, "preprocessing": True, "enabled": False},
                {"name": "no address", "type": "int16"}, {"address": 102, "type": "int16"},
                {"address": 103, "name": "bad type", "type": "int8"},
                {"address": 104, "name": "bad space", "type": "int16", "regType": "flash"},
                {"address": 70000, "name": "too far", "type": "int16"},
            ],
            "ranges": [
                {"start": 100, "count": 2, "period": "5s"}, {"start": 100, "count": 2, "period": "4s"},
                {"start": 100, "period": "5s"}, {"start": 65500, "count": 100, "period": "5s"},
                {"start": 65500, "count": 36, "period": "1d", "regType": "coil"},
                {"start": 300, "count": 10, "period": "5s"}, {"start": 309, "count": 1, "period": "5s"},
            ],
        },
        {
            "id": 2, "isZero": False, "enabled": False,
            "connection": {"port": "/dev/x", "baud_rate": 9600, "parity": "Q", "data_bits": 8, "stop_bits": 1},
            "registers": [],
        },
        {"connection": {}, "registers": [{"address": 1, "name": "lost", "type": "int16"}]},
    ]
}


def test_catalog_from_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(CONFIG, indent=2))
    (tmp_path / "two.json").write_text("{}")
    catalog = read_register_catalog(spark, str(tmp_path))
    regs = {r["name"]: r for r in catalog.registers.collect()}
    assert set(regs) == {"a", "b"}
    a, b = regs["a"], regs["b"]
    assert (a["reg_type"], a["scale"], a["preprocessing"], a["enabled"]) == ("holding", 1.0, False, True)
    assert (b["reg_type"], b["scale"], b["preprocessing"], b["enabled"]) == ("input", 0.1, True, False)
    ranges = rows(catalog.ranges.select("start", "count", "period_seconds", "reg_type"))
    assert ranges == [(100, 2, 5, "holding"), (65500, 36, 86400, "coil")]
    devices = catalog.devices.collect()
    assert [(d["id"], d["is_zero"], d["enabled"], d["connection"]["parity"]) for d in devices] == [(1, True, True, "N")]
    reasons = sorted(r["reason"] for r in catalog.rejects.collect())
    assert reasons == sorted([
        "register without a valid 'address'", "register without 'name'", "invalid register type",
        "invalid register space", "register without a valid 'address'", "invalid period",
        "range without a valid 'count'", "range beyond the address space", "invalid parity",
        "device without 'id'", "register of a device without 'id'", "missing or invalid 'devices'",
        "overlapping range", "overlapping range",
    ])


def test_strict_catalog_fails(spark):
    texts = spark.createDataFrame([("x", json.dumps(CONFIG))], "source string, json string")
    with pytest.raises(Exception, match="register without"):
        parse_catalog(texts, strict=True).registers.collect()


def test_wide_types_and_drift(spark, telemetry):
    regs = registers(spark, [
        (1, 1, "vpv1(V)", "uint16", {"scale": 0.1}), (1, 2, "ppv1(W)", "uint16"), (1, 3, "f", "float32"),
        (1, 4, "i32", "int32", {"scale": 0.01}), (1, 5, "u32", "uint32"), (1, 6, "u64", "uint64"),
        (1, 7, "u64s", "uint64", {"scale": 0.5}), (1, 8, "u32s", "uint32", {"scale": 0.5}), (1, 9, "i32w", "int32", {"scale": 2.0}),
    ])
    types = {r["name"]: r["column_type"] for r in wide_columns(regs).collect()}
    assert types == {
        "vpv1(V)": "DECIMAL(6,2)", "ppv1(W)": "INTEGER", "f": "FLOAT", "i32": "DECIMAL(10,2)", "u32": "BIGINT",
        "u64": "DECIMAL(20,0)", "u64s": "DECIMAL(20,2)", "u32s": "DECIMAL(10,2)", "i32w": "INTEGER",
    }
    wide = snapshot(telemetry([(1, TS, "vpv1(V)", 12.345), (1, TS, "ppv1(W)", 7.0)]), registers=["vpv1(V)", "ppv1(W)"])
    typed = cast_wide(wide, types)
    assert [f.dataType.simpleString() for f in typed.schema] == ["timestamp", "decimal(6,2)", "int"]
    assert (str(typed.first()["vpv1"]), typed.first()["ppv1"]) == ("12.35", 7)
    drift = schema_drift(typed, {"VPV1": "DECIMAL(6, 2)", "ppv1": "BIGINT", "none": "int"})
    assert rows(drift) == [("none", None, "int"), ("ppv1", "int", "BIGINT")]


def test_values_beyond_their_type_are_rejected(spark):
    regs = registers(spark, [
        (1, 1, "vpv1(V)", "uint16", {"scale": 0.1}), (1, 2, "ppv1(W)", "uint16"), (1, 3, "f", "float32"),
        (1, 4, "gone", "uint16", {"enabled": False}),
    ])
    types = catalog_types(regs)
    assert types == {"vpv1(V)": "DECIMAL(6,2)", "ppv1(W)": "INTEGER", "f": "FLOAT"}
    nan = float("nan")
    wide = spark.createDataFrame(
        [(1, 9999.99, 7.0, 1.0), (2, 10000.0, 3e9, 2.0), (3, None, nan, nan), (4, -9999.99, -1.0, None)],
        "n int, vpv1 double, ppv1 double, f double")
    assert [tuple(r)[1:3] for r in cast_wide(wide, types).orderBy("n").collect()][1:3] == [(None, None), (None, None)]
    assert rows(rejected_values(wide, types, ["n"])) == [
        (2, "ppv1", "3.0E9", "INTEGER"), (2, "vpv1", "10000.0", "DECIMAL(6,2)"), (3, "ppv1", "NaN", "INTEGER")]
    assert rejected_values(wide.select("n"), types, ["n"]).count() == 0
    assert rejected_values(wide.limit(0), types, ["n"]).count() == 0


def test_drift_over_stored_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "with space")
    spark.range(3).selectExpr("id", "CAST(id AS DECIMAL(6,2)) AS Vpv1").coalesce(1).write.parquet(path + "/a")
    spark.range(3).selectExpr("CAST(id AS INT) AS id", "1 AS extra").coalesce(1).write.parquet(path + "/b=1")
    # A file that Spark has not written has no schema of Spark's.
    pq.write_table(pa.table({"ID": pa.array([1], pa.int64()), "vpv1": pa.array([1.0])}), path + "/b=1/own.parquet")
    found = {(c, t) for _, c, t in rows(stored_columns(spark, path, ["VPV1"]))}
    assert found == {("id", "bigint"), ("Vpv1", "decimal(6,2)"), ("id", "int"), ("extra", "int"), ("VPV1", None),
                     ("ID", "bigint"), ("vpv1", "double")}
    drift = stored_drift(spark, path, {"id": "BIGINT", "VPV1": "Decimal(6, 2)"})
    report = drift_report(drift).drop("a_file")
    assert rows(report) == [
        ("id", "int", "BIGINT", 1), ("vpv1", None, "Decimal(6, 2)", 1), ("vpv1", "double", "Decimal(6, 2)", 1)]
    assert stored_drift(spark, path, {}).count() == 0
