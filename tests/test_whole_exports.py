"""CSV exports that are read whole bring their header; exports are written a file each, in one folder."""

import os

import pytest
from pyspark.sql import functions as F

from wattline.sources import wide
from wattline.sources.wide import (
    bad_exports, export_headers, read_export_lines, read_wide_exports, unpivot_rows, wide_rows, write_exports,
)

FILES = {
    "a.csv": 'Report\n\nTime,"a(n)",b\n2024-01-01 00:00:00, 1 ,"2,5"\n2024-01-01 00:01:00,"3",""""\n',
    "b.csv": "﻿Time,b\r\n2024-01-01 00:00:00,7\r\n\r\n2024-01-01 00:02:00,8",
    "c.csv": "x\rTimes,Time\rlater,2024-01-01 00:00:00\r",
    "d.csv": "no header\n1,2\n",
    "e.csv": "",
    "f.csv": '"Time is",1\nTime,a(n)\n,5\n2024-01-01 00:00:00\n﻿2024-01-02 00:00:00,"open\n\n\n',
}


def seen(spark, folder):
    lines = read_export_lines(spark, folder)
    cells = {}
    for r in lines.orderBy("file", "block", "line_no").collect():
        cells.setdefault(r["file"][-5:], []).append((r["cells"], r["titled"]))
    headers = {r["file"][-5:]: r["header"] for r in export_headers(lines).collect()}
    rows = read_wide_exports(spark, folder).orderBy("file", "block", "line_no").collect()
    long = unpivot_rows(read_wide_exports(spark, folder), ["a(n)", "b"]).orderBy("file", "line_no", "register_name").collect()
    return cells, headers, sorted(r["file"][-5:] for r in bad_exports(lines).collect()), [
        (r["file"][-5:], r["Time"], r["cells"]) for r in rows], [(r["file"][-5:], r["Time"], r[5], r[6]) for r in long]


def test_whole_files_and_ranges_give_the_same(spark, tmp_path, monkeypatch):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = read_export_lines(spark, str(tmp_path))
    assert lines.filter("whole").select("file").distinct().count() == 5
    found = seen(spark, str(tmp_path))
    monkeypatch.setattr(wide, "WHOLE_FILE", -1)
    assert read_export_lines(spark, str(tmp_path)).filter("whole").count() == 0
    assert found == seen(spark, str(tmp_path))
    assert found[1]["a.csv"] == ["Time", "a(n)", "b"] and found[2] == ["d.csv"]
    # Some files of either kind.
    monkeypatch.setattr(wide, "WHOLE_FILE", 40)
    assert found == seen(spark, str(tmp_path))


def test_lines_of_whole_files_are_not_joined(spark, tmp_path):
    (tmp_path / "a.csv").write_text(FILES["a.csv"])
    lines = read_export_lines(spark, str(tmp_path))
    rows = wide_rows(lines, export_headers(lines))
    assert rows.count() == 4
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joined = [r for r in plan.split("\n") if "Join" in r]
    # Only larger files, cut into ranges, meet a table of headers, and that has no header of a file read whole.
    assert len(joined) == 1 and "Union" in plan and plan.count("posexplode") == 1


@pytest.mark.parametrize("batch", [3, 10_000])
def test_exports_are_one_file_for_each_value(spark, tmp_path, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        rows = spark.range(40).select(
            F.when(F.col("id") % 5 > 0, F.concat(F.lit("a/"), F.col("id") % 5)).alias("book"),
            F.when(F.col("id") != 7, F.concat(F.lit("x,"), "id")).alias("text"))
        path = str(tmp_path / "w")
        counts = write_exports(rows, path, "book", "text", ["Report", "Time,id"]).collect()
        assert sorted((r["file"] or "", r["n_rows"]) for r in counts) == [(x, 8) for x in ("", "a/1", "a/2", "a/3", "a/4")]
        assert sorted(os.listdir(path)) == sorted(
            f"book={x}.csv" for x in ("__HIVE_DEFAULT_PARTITION__", "a%2F1", "a%2F2", "a%2F3", "a%2F4"))
        for n, name in ((1, "a%2F1"), (2, "a%2F2"), (0, "__HIVE_DEFAULT_PARTITION__")):
            lines = open(f"{path}/book={name}.csv").read().split("\n")
            assert lines[:2] == ["Report", "Time,id"] and lines[-1] == ""
            assert sorted(lines[2:-1]) == sorted("" if i == 7 else f"x,{i}" for i in range(n, 40, 5))
    finally:
        spark.conf.set(key, before)


def test_no_exports_leave_an_empty_folder(spark, tmp_path):
    rows = spark.range(0).select(F.lit("f").alias("file"), F.lit("x").alias("text"))
    assert write_exports(rows, str(tmp_path / "none"), "file", "text").count() == 0
    assert read_export_lines(spark, str(tmp_path / "none")).count() == 0
