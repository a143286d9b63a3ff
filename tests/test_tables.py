import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattline.operators.refresh import (
    DAY_OFFSETS, MINUTE_OFFSETS, refresh_table, refresh_window, upsert_table, whole_buckets,
)
from wattline.operators.snapshot import snapshot, snapshot_long
from wattline.operators.stats import tariff_stats
from wattline.plans.reports import ingest_exports
from wattline.session import scratch_path, shared_dir
from wattline.sources.telemetry import (
    append_telemetry, committed_versions, distinct_registers, read_directory, read_prices, read_staging,
    read_telemetry, row_count, write_staging,
)
from wattline.sources.wide import (
    bad_exports, export_headers, import_long, import_wide, missing_columns, read_export_lines,
    read_wide_exports, read_xlsx_lines, unpivot_rows, unpivot_table,
)
from wattline.streaming.jobs import (
    append_batches, run_available, stream_dedup, stream_snapshot, stream_tariff_stats, upsert_batches,
)

DAY = "2024-01-10"
UTC = dt.timezone.utc


def test_append_takes_each_key_once(spark, telemetry, tmp_path):
    path = str(tmp_path / "t")
    first = telemetry([
        (1, f"{DAY} 10:00:00.1234", "a", 1.0), (1, f"{DAY} 10:00:00.1239", "a", 2.0), (1, f"{DAY} 10:00:00.124", "a", 3.0),
    ])
    append_telemetry(spark, first, path)
    append_telemetry(spark, telemetry([(1, f"{DAY} 10:00:00.123", "a", 9.0), (2, "2024-01-11 00:00:00", "a", 4.0)]), path)
    append_telemetry(spark, first, path)
    stored = read_telemetry(spark, path)
    assert rows(stored.select("device_id", "timestamp", "value", "date")) == [
        (1, f"{DAY} 10:00:00.123000", 1.0, DAY), (1, f"{DAY} 10:00:00.124000", 3.0, DAY),
        (2, "2024-01-11 00:00:00", 4.0, "2024-01-11"),
    ]
    assert row_count(stored).first()["n_rows"] == 3
    assert rows(distinct_registers(stored)) == [("a",)]


def test_many_copies_of_one_key(spark, telemetry, tmp_path):
    base = telemetry([(1, f"{DAY} 10:00:00", "a", 1.0)])
    copies = base.crossJoin(spark.range(5000).select(F.col("id").alias("n"))).withColumn("id", F.col("n")).drop("n")
    append_telemetry(spark, copies.withColumn("value", F.col("id") * 1.0), str(tmp_path / "t"))
    assert rows(read_telemetry(spark, str(tmp_path / "t")).select("id", "value")) == [(0, 0.0)]


def test_filters_prune_days(spark, telemetry, tmp_path):
    from wattline.operators.latest import last_value_at

    path = str(tmp_path / "t")
    append_telemetry(spark, telemetry([(1, f"2024-01-{d:02} 10:00:00", "a", 1.0) for d in range(1, 20)]), path)
    df = last_value_at(read_telemetry(spark, path), "2024-01-05 12:00:00", ["a"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(date" in scan and "(date" in scan and "2024-01-05" in scan
    assert "GreaterThanOrEqual(timestamp" in scan and "EqualTo(register_name,a)" in scan
    assert rows(df)[0][2] == 1.0


def test_staging_is_replaced(spark, telemetry, tmp_path):
    for n in (3, 2):
        write_staging(telemetry([(1, f"{DAY} 10:00:0{i}", "a", 1.0) for i in range(n)]), str(tmp_path / "s"))
    assert read_staging(spark, str(tmp_path / "s")).count() == 2


def test_failed_load_leaves_the_staging_table(spark, telemetry, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="no whole version"):
        read_staging(spark, path)
    good = telemetry([(1, f"{DAY} 10:00:0{i}", "a", float(i)) for i in range(4)])
    write_staging(good, path)
    # The load fails in one task, when others have written their files.
    broken = good.repartition(4, "value").withColumn(
        "value", F.when(F.col("value") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("value") + 10).cast("double"))
    with pytest.raises(Exception, match="broken"):
        write_staging(broken, path)
    assert rows(read_staging(spark, path)) == rows(good)
    write_staging(good.filter("value > 1"), path)
    assert rows(read_staging(spark, path)) == rows(good.filter("value > 1"))


def test_staging_keeps_the_version_before(spark, telemetry, tmp_path):
    path = str(tmp_path / "s")
    loads = [telemetry([(1, f"{DAY} 10:00:00", "a", float(n))]) for n in range(4)]
    write_staging(loads[0], path)
    for load in loads[1:]:
        reader = read_staging(spark, path)
        write_staging(load, path)
        assert reader.count() == 1  # a reader from before the switch
    assert committed_versions(spark, path) == [3, 4]
    assert sorted(x for x in os.listdir(path) if x.startswith("version")) == ["version-3", "version-4"]
    write_staging(loads[0].limit(0), path)
    assert read_staging(spark, path).count() == 0


def test_dimensions(spark, tmp_path):
    spark.sql("SELECT 'a' AS register_name, 'A' AS ua_friendly_name, '' AS unit").write.parquet(str(tmp_path / "d"))
    spark.sql("SELECT timestamp'2024-01-01' AS dt, 1.0D AS dprice, 2.0D AS nprice").write.parquet(str(tmp_path / "p"))
    assert rows(read_directory(spark, str(tmp_path / "d"))) == [("a", "A", "")]
    assert rows(read_prices(spark, str(tmp_path / "p"))) == [("2024-01-01 00:00:00", 1.0, 2.0)]


def test_shared_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_windows_hold_whole_buckets():
    low, high = refresh_window("2024-01-25 06:00:30", MINUTE_OFFSETS, "1 minute")
    assert (low, high) == (dt.datetime(2024, 1, 25, 4, 1, tzinfo=UTC), dt.datetime(2024, 1, 25, 5, 59, tzinfo=UTC))
    low, high = refresh_window("2024-01-25 06:00:00", DAY_OFFSETS, "1 day")
    assert (low, high) == (dt.datetime(2024, 1, 12, tzinfo=UTC), dt.datetime(2024, 1, 25, tzinfo=UTC))
    low, high = whole_buckets("2024-01-25 06:00:10", "2024-01-25 06:00:50", "1 minute")
    assert low == high
    assert whole_buckets("1999-12-30", "2000-01-20", "1 week")[0] == dt.datetime(2000, 1, 3, tzinfo=UTC)


def test_refresh_replaces_only_its_window(spark, telemetry, tmp_path):
    path = str(tmp_path / "agg")
    early = [(1, f"{DAY} {h:02}:00:10", "vpv1(V)", float(h)) for h in range(0, 12)]
    refresh_table(spark, telemetry(early), snapshot, path, whole_buckets(DAY, "2024-01-12", "1 minute"), "minutets")
    late = [(1, f"{DAY} {h:02}:00:20", "vpv1(V)", 100.0 + h) for h in range(0, 14)]
    window = whole_buckets(f"{DAY} 05:00:00", f"{DAY} 08:00:30", "1 minute")
    for _ in range(2):
        refresh_table(spark, telemetry(early + late), snapshot, path, window, "minutets")
    got = {r["minutets"].hour: r["vpv1"] for r in spark.read.parquet(path).collect()}
    assert got == {h: (100.0 + h if 5 <= h < 8 else float(h)) for h in range(12)}
    refresh_table(spark, telemetry(late), snapshot, path, (window[0], window[0]), "minutets")
    assert spark.read.parquet(path).count() == 12


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "u")

    def table(data):
        return spark.createDataFrame(data, "day string, k int, v int").withColumn("day", F.to_timestamp("day"))

    upsert_table(spark, table([(DAY, 1, 1), (DAY, 2, 2), ("2024-01-11", 1, 3)]), path, ["day", "k"], "day")
    upsert_table(spark, table([(DAY, 1, 9), (DAY, 3, 8)]), path, ["day", "k"], "day")
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, 3), (1, 9), (2, 2), (3, 8)]


def files(telemetry, folder, parts):
    """One Parquet file per part, read by a stream in this order."""
    os.makedirs(folder / "files", exist_ok=True)
    for i, part in enumerate(parts):
        telemetry(part).coalesce(1).write.parquet(str(folder / f"part{i}"))
        name = next(f for f in os.listdir(folder / f"part{i}") if f.endswith(".parquet"))
        target = folder / "files" / f"{i}.parquet"
        os.rename(folder / f"part{i}" / name, target)
        os.utime(target, (i + 1, i + 1))
    return str(folder / "files")


@pytest.fixture
def source(spark, telemetry, tmp_path):
    def make(parts):
        path = files(telemetry, tmp_path, parts)
        schema = spark.read.parquet(path).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)

    return make


PARTS = [
    [(1, f"{DAY} 10:00:{s:02}", "c", float(s)) for s in range(0, 60, 7)] + [(1, f"{DAY} 23:30:00", "c", 70.0)],
    [(1, f"{DAY} 10:00:{s:02}", "c", 90.0 + s) for s in range(1, 60, 7)] + [(2, "2024-01-11 03:00:00", "c", 5.0)],
    [(1, "2024-01-11 09:00:00", "c", 100.0), (1, f"{DAY} 08:00:00", "c", -1.0)],
]


def test_stream_snapshot_closes_minutes_behind_the_watermark(spark, source, tmp_path):
    stream, batch = source(PARTS[:2] + [[(1, "2024-01-11 09:00:00", "c", 100.0)]])
    run_available(stream_snapshot(stream, lateness="14 hours"), str(tmp_path / "o"), str(tmp_path / "c"))
    want = snapshot_long(batch).filter("minutets < '2024-01-10 19:00:00'")
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == rows(want)


def test_stream_tariff_equals_batch_after_late_rows(spark, source, tmp_path):
    stream, batch = source(PARTS)
    keys = ["day", "device_id", "register_name", "zone"]
    out = str(tmp_path / "o")
    run_available(
        stream_tariff_stats(stream, ["c"]), None, str(tmp_path / "c"), "update", upsert_batches(spark, out, keys, "day")
    )
    want = tariff_stats(batch, ["c"])
    assert rows(spark.read.parquet(out).select(*want.columns)) == rows(want)


def test_stream_append_and_dedup(spark, source, tmp_path):
    stream, batch = source([PARTS[0], PARTS[0], PARTS[1]])
    out = str(tmp_path / "o")
    run_available(stream, None, str(tmp_path / "c"), "append", append_batches(spark, out))
    assert read_telemetry(spark, out).count() == batch.dropDuplicates(["device_id", "timestamp", "register_name"]).count()
    run_available(stream_dedup(stream, "2 days"), str(tmp_path / "d"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == read_telemetry(spark, out).count()


EXPORT = """Report of plant,,,
made by hand,,,
Time,batteryTemp(℃)/586,totalUsed(kWh)/527-528,unknown/999
2024-01-01 00:00:00,21.5,100,1
2024-01-01 00:05:00,21.5,100,2
2024-01-01 00:10:00,abc,101,3
2024-01-01 00:15:00,21.5,"101",4
,22,102,5
2024-01-01 00:20:00,0,0,6
2024-01-01 00:25:00,21.5,101,7
not a time,50,500,8
"""
KNOWN = ["batteryTemp(C)", "totalUsed(kWh)", "pf(NA)"]
LONG = [
    ("2024-01-01 00:00:00", "batteryTemp(C)", 21.5), ("2024-01-01 00:00:00", "totalUsed(kWh)", 100.0),
    ("2024-01-01 00:10:00", "totalUsed(kWh)", 101.0), ("2024-01-01 00:15:00", "batteryTemp(C)", 21.5),
]


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "exports"
    path.mkdir()
    (path / "a.csv").write_text(EXPORT)
    (path / "b.csv").write_text('x\ny\nTime,"totalUsed(kWh)/527-528",batteryTemp(℃)/586\n"2024-01-01 00:00:00",100,\n')
    (path / "c.csv").write_text("x\ny\nTime,nothing/100\n2024-01-01 00:00:00,1\n")
    (path / "d.csv").write_text("no header\n1,2\n")
    return str(path)


def test_import_of_exports(spark, folder):
    got = import_wide(read_wide_exports(spark, folder), KNOWN, device_id=7)
    per_file = {}
    for r in got.collect():
        per_file.setdefault(r["file"][-5:], []).append((str(r["timestamp"]), r["register_name"], r["value"]))
        assert r["device_id"] == 7 and r["id"] == int(r["timestamp"].replace(tzinfo=UTC).timestamp())
    assert {k: sorted(v) for k, v in per_file.items()} == {
        "a.csv": LONG, "b.csv": [("2024-01-01 00:00:00", "totalUsed(kWh)", 100.0)],
    }
    assert ingest_exports(spark, folder, KNOWN).columns == ["id", "device_id", "timestamp", "register_name", "value"]


def test_columns_and_bad_files(spark, folder):
    lines = read_export_lines(spark, folder)
    missing = missing_columns(export_headers(lines), KNOWN)
    got = sorted((r["file"][-5:], r["register_name"]) for r in missing.collect())
    assert got == [("a.csv", "pf(NA)"), ("b.csv", "pf(NA)")] + [("c.csv", k) for k in sorted(KNOWN)]
    assert [r["file"][-5:] for r in bad_exports(lines).collect()] == ["d.csv"]


def workbook(path, rows, shared=True):
    import zipfile
    from xml.sax.saxutils import escape

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts, body = [], []
    for y, row in enumerate(rows, 1):
        cells = []
        for x, value in enumerate(row):
            place = f"{'ABCDE'[x]}{y}"
            if value is None:
                continue
            if isinstance(value, str) and shared:
                texts.append(f"<si><t>{escape(value)}</t></si>")
                cells.append(f'<c r="{place}" t="s"><v>{len(texts) - 1}</v></c>')
            elif isinstance(value, str):
                cells.append(f'<c r="{place}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            else:
                cells.append(f'<c r="{place}"><v>{value}</v></c>')
        body.append(f'<row r="{y}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(texts)}</sst>")


def test_import_of_workbooks(spark, tmp_path):
    head = [["Report"], [None], ["totalUsed(kWh)/527-528", "Time", "batteryTemp(℃)/586"]]
    workbook(tmp_path / "a.xlsx", head + [[100, "2024-01-01 00:00:00", 21.5], [100, "2024-01-01 00:05:00", None]])
    # The same times as days since 1899-12-30.
    workbook(tmp_path / "b.xlsx", head + [[7, 45292, None], [8, 45292 + 1 / 288, 1]], shared=False)
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    got = import_wide(read_wide_exports(spark, str(tmp_path), xlsx=True), KNOWN)
    assert [(f[-6], t, r, v) for f, t, r, v in rows(got.select("file", "timestamp", "register_name", "value"))] == [
        ("a", "2024-01-01 00:00:00", "batteryTemp(C)", 21.5), ("a", "2024-01-01 00:00:00", "totalUsed(kWh)", 100.0),
        ("b", "2024-01-01 00:00:00", "totalUsed(kWh)", 7.0), ("b", "2024-01-01 00:05:00", "batteryTemp(C)", 1.0),
        ("b", "2024-01-01 00:05:00", "totalUsed(kWh)", 8.0),
    ]
    assert [r["file"][-6:] for r in bad_exports(read_xlsx_lines(spark, str(tmp_path))).collect()] == ["c.xlsx"]


@pytest.mark.parametrize("code, date", [
    ("yyyy-mm-dd", True), ("d/m/yy h:mm", True), ("0.00", False), ("General", False), ('0.0 "days"', False),
    ("[h]:mm:ss", False), ("[Red]0;[Blue]yyyy", False), (r"0\d", False), ("[$-409]d\\-mmm", True),
])
def test_formats_that_show_a_date(code, date):
    from wattline.sources.wide import _shows_a_date

    assert _shows_a_date(code) is date


@pytest.mark.parametrize("epoch, days", [(0, 45292.5), (1, 43830.5)])
def test_dates_of_workbooks_by_their_format(spark, tmp_path, epoch, days):
    """Only cells whose format says so are dates; the calendar is the workbook's."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    line = f'<c t="str"><v>Time</v></c><c t="str"><v>totalUsed(kWh)/527-528</v></c><c t="str"><v>batteryTemp(℃)/586</v></c>'
    rows_ = [
        line, f'<c s="2"><v>{days}</v></c><c><v>{days}</v></c><c s="1"><v>21.5</v></c>',
        f'<c s="1"><v>45293</v></c><c><v>8</v></c><c s="2"><v>{days}</v></c>',
    ]
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{r}"><workbookPr date1904="{epoch}"/><sheets>'
                      '<sheet name="x" sheetId="1" r:id="r9"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r9" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="0.0 &quot;d&quot;"/></numFmts>'
                      '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(
            f'<row r="{i}">{x}</row>' for i, x in enumerate(rows_, 1)) + "</sheetData></worksheet>")
    long = read_wide_exports(spark, str(tmp_path), xlsx=True)
    got = rows(unpivot_rows(long, KNOWN).select("timestamp", "register_name", "value"))
    assert got == [
        ("2024-01-01 12:00:00", "batteryTemp(C)", 21.5), ("2024-01-01 12:00:00", "totalUsed(kWh)", days),
        # A plain number in the time column counts from 1900, a date among the values is no number.
        ("2024-01-02 00:00:00", "batteryTemp(C)", None), ("2024-01-02 00:00:00", "totalUsed(kWh)", 8.0)]


def test_append_looks_only_at_the_days_it_touches(spark, telemetry, tmp_path):
    from wattline.sources.telemetry import days_of, read_days, with_date

    path = str(tmp_path / "t")
    append_telemetry(spark, telemetry([(1, f"2024-01-{d:02} 10:00:00", "a", 1.0) for d in range(1, 20)]), path)
    # A file of another day that no reader gets through; a day between those of the batch, too.
    for day in ("2024-01-19", "2024-01-07"):
        other = os.path.join(path, f"date={day}")
        for name in os.listdir(other):
            with open(os.path.join(other, name), "wb") as broken:
                broken.write(b"broken")
    batch = telemetry([
        (1, "2024-01-05 10:00:00", "a", 2.0), (1, "2024-01-08 11:00:00", "a", 2.0), (1, "2030-01-08 11:00:00", "a", 2.0),
    ])
    found = read_days(spark, path, days_of(with_date(batch)))
    assert len(found.inputFiles()) == 2 and all("01-05" in f or "01-08" in f for f in found.inputFiles())
    append_telemetry(spark, batch, path)
    assert os.path.isdir(os.path.join(path, "date=2030-01-08"))
    assert read_days(spark, path, days_of(with_date(batch))).count() == 4
    assert read_days(spark, path, []) is None


def test_cells_in_quotes(spark):
    from wattline.sources.wide import _cells

    texts = {'a,"b,c",d': ["a", "b,c", "d"], '"x ""y""",': ['x "y"', ""], "": [""], 'a,"open,b': ["a", '"open,b'], ",": ["", ""], ",,a": ["", "", "a"],
             ",".join(["1"] * 5000): ["1"] * 5000}
    df = spark.createDataFrame([(x,) for x in texts], "line string").withColumn("cells", _cells(F.col("line")))
    assert {r["line"]: r["cells"] for r in df.collect()} == texts


def test_first_sheet_of_another_name(spark, tmp_path):
    import zipfile

    workbook(tmp_path / "a.xlsx", [["Time", "totalUsed(kWh)/527-528"], ["2024-01-01 00:00:00", 7]])
    with zipfile.ZipFile(tmp_path / "a.xlsx") as old, zipfile.ZipFile(tmp_path / "b.xlsx", "w") as new:
        for name in old.namelist():
            new.writestr(name.replace("sheet1", "data"), old.read(name))
        main, relations = ("http://schemas.openxmlformats.org/" + x for x in (
            "spreadsheetml/2006/main", "officeDocument/2006/relationships"))
        new.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets>'
                     '<sheet name="A" sheetId="2" r:id="rId7"/><sheet name="B" sheetId="1" r:id="rId1"/></sheets></workbook>')
        new.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/none.xml"/>'
                     '<Relationship Id="rId7" Target="worksheets/data.xml"/></Relationships>')
    os.remove(tmp_path / "a.xlsx")
    got = import_wide(read_wide_exports(spark, str(tmp_path), xlsx=True), KNOWN)
    assert [r["value"] for r in got.collect()] == [7.0]


def test_unreadable_times_are_listed(spark):
    from wattline.sources.wide import unreadable_times

    df = spark.createDataFrame([("f", 1, "2024-01-01 00:00:00", "1"), ("f", 2, "soon-ish", "2")], ["file", "line_no", "Time", "a"])
    assert [tuple(r) for r in unreadable_times(unpivot_table(df, ["a"])).collect()] == [("f", 0, 2, "soon-ish")]


@pytest.mark.parametrize("seed, want", [("resume", [0, 2, 3]), ("reference", [0, 2, 3, 4])])
def test_ingest_goes_on_after_a_restart(spark, tmp_path, seed, want):
    from wattline.streaming.jobs import stream_ingest

    columns = "device_id int, reg_type string, ts timestamp, start int, words array<int>, frame_id long"
    catalog = spark.sql("""SELECT 1 AS device_id, 'holding' AS reg_type, 0 AS address, 'r' AS name, 'uint16' AS type,
        1.0D AS scale, false AS preprocessing, true AS enabled, 0 AS register_no""")
    frames, path, checkpoint = (str(tmp_path / x) for x in ("frames", "table", "checkpoint"))
    at = [("10:00", 5), ("10:01", 5), ("10:02", 6), ("11:10", 6), ("11:11", 6), ("11:12", 6)]
    rows = [(1, "holding", dt.datetime.fromisoformat(f"2024-01-01 {t}"), 0, [v], i) for i, (t, v) in enumerate(at)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(frames)
        stream = spark.readStream.schema(columns).parquet(frames)
        stream_ingest(spark, stream, catalog, path, checkpoint, "20 seconds", seed)
    assert sorted(r["id"] for r in read_telemetry(spark, path).collect()) == want


def test_ingest_seeds_from_the_table(spark, tmp_path):
    """Starts without states; the series of device 2 was last stored days before that of device 1, and a
    batch that runs again does not start from its own rows."""
    from wattline.sources.telemetry import append_telemetry, last_stored
    from wattline.streaming.jobs import ingest_batches, stream_ingest

    columns = "device_id int, reg_type string, ts timestamp, start int, words array<int>, frame_id long"
    catalog = spark.sql("""SELECT id AS device_id, 'holding' AS reg_type, 0 AS address, 'r' AS name, 'uint16' AS type,
        1.0D AS scale, false AS preprocessing, true AS enabled, 0 AS register_no FROM VALUES (1), (2), (3) AS t(id)""")
    frames, path = str(tmp_path / "frames"), str(tmp_path / "table")
    append_telemetry(spark, spark.sql("""SELECT i AS id, d AS device_id, timestamp(t) AS timestamp, 'r' AS register_name,
        v AS value FROM VALUES (0L, 1, '2024-01-09 23:00', 4D), (1L, 1, '2024-01-09 23:30', 5D),
        (2L, 2, '2024-01-01 00:00', 7D), (3L, 2, '2023-12-01 00:00', 8D) AS x(i, d, t, v)"""), path)
    wanted = spark.createDataFrame([(d, "r") for d in (1, 2, 3)], "device_id int, register_name string")
    assert [r[3] for r in rows(last_stored(spark, path, wanted))] == [5.0, 7.0]
    assert last_stored(spark, str(tmp_path / "none"), wanted).count() == 0
    at = [(1, "2024-01-09 23:31", 5), (1, "2024-01-09 23:32", 6), (2, "2024-01-09 23:31", 7), (3, "2024-01-09 23:31", 9)]
    batch = spark.createDataFrame(
        [(d, "holding", dt.datetime.fromisoformat(t), 0, [v], 10 + i) for i, (d, t, v) in enumerate(at)], columns)
    write = ingest_batches(spark, catalog, path, str(tmp_path / "states"), "20 minutes", "sink")
    for _ in range(2):
        write(batch, 0)
    # 5 again within the hold goes; 7 is due after days, and 9 is the first of its series.
    assert sorted(r["id"] for r in read_telemetry(spark, path).collect()) == [0, 1, 2, 3, 11, 12, 13]
    batch.limit(0).write.parquet(frames)
    stream = spark.readStream.schema(columns).parquet(frames)
    stream_ingest(spark, stream, catalog, path, str(tmp_path / "checkpoint"), "20 minutes", "sink")


def test_import_of_a_wide_table(spark):
    lines = [line.split(",") for line in EXPORT.replace('"', "").splitlines()[3:]]
    names = ["batteryTemp(℃)/586", "totalUsed(kWh)/527-528", "unknown/999"]
    df = spark.createDataFrame([("f", i, *line) for i, line in enumerate(lines)], ["file", "line_no", "Time", *names])
    got = import_long(unpivot_table(df, KNOWN))
    assert rows(got.select("timestamp", "register_name", "value")) == LONG


def test_zero_goes_after_the_change_filter(spark):
    data = [("f", i, f"{DAY} 10:0{i}:00", v, "1") for i, v in enumerate(["5", "0", "5", "NaN", "1d", " 6 ", "6.0", "1e1"])]
    df = spark.createDataFrame(data, ["file", "line_no", "Time", "a", "b"])
    got = import_long(unpivot_table(df, ["a", "b"]))
    assert unpivot_table(df, ["none"]).count() == 0
    assert [v for _, r, v in rows(got.select("timestamp", "register_name", "value")) if r == "a"] == [5.0, 5.0, 6.0, 10.0]


def test_headers_of_workbooks_are_read_without_the_rows_below(spark, tmp_path):
    from wattline.sources.wide import write_workbooks

    rows = spark.range(40).select(F.lit(3).alias("book"), F.col("id").cast("timestamp").alias("at"), "id")
    write_workbooks(rows, str(tmp_path / "w"), "book", F.col("at"), {"a(n)/1": F.col("id")}).collect()
    heads = read_xlsx_lines(spark, str(tmp_path / "w"), heads=True)
    assert [r["cells"] for r in heads.orderBy("line_no").collect()] == [["Report"], [], ["Time", "a(n)/1"]]
    assert read_xlsx_lines(spark, str(tmp_path / "w")).count() == 43
    assert read_wide_exports(spark, str(tmp_path / "w"), xlsx=True).filter("Time <> 'Report'").count() == 40


def test_lines_without_time_are_not_cut_for_headers(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text('x\n"Time",a(n)\n2024-01-01 00:00:00,1\n')
    lines = read_export_lines(spark, str(tmp_path / "e"))
    assert [r["titled"] for r in lines.orderBy("line_no").collect()] == [False, True, False]
    assert [r["header"] for r in export_headers(lines).collect()] == [["Time", "a(n)"]]
