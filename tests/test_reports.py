import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattline.catalog import DAY_RULES, MINUTE_REGISTERS, PERIOD_RULES, parse_rules
from wattline.operators import series
from wattline.operators.latest import last_known, last_value_at, period_diff
from wattline.operators.series import period_values
from wattline.operators.snapshot import param_history, period_stat, snapshot, snapshot_long
from wattline.operators.stats import (
    bucket_stats, price_at, tariff_report, tariff_report_sum, tariff_stats, with_price,
)
from wattline.plans.reports import daily_tariff_report, history

DAY = "2024-01-10"


def test_rule_counts():
    day, period = parse_rules(DAY_RULES), parse_rules(PERIOD_RULES)
    kinds = [c[0] for _, _, c in day]
    assert len(day) == 171 and len(set(c for _, _, c in day)) == 171
    assert {k: kinds.count(k) for k in "xnadec"} == {"x": 48, "n": 50, "a": 48, "d": 11, "e": 10, "c": 4}
    kinds = [c[0] for _, _, c in period]
    assert len(period) == 193 and len(set(c for _, _, c in period)) == 193
    assert {k: kinds.count(k) for k in "xand"} == {"x": 72, "a": 60, "n": 50, "d": 11}
    assert len(MINUTE_REGISTERS) == len(set(MINUTE_REGISTERS)) == 91


def test_latest_null_wins_and_lookback_is_closed(telemetry):
    t = telemetry([
        (1, f"{DAY} 08:00:00", "edge", 1.0), (1, f"{DAY} 07:59:59", "old", 1.0),
        (1, f"{DAY} 10:00:00", "gone", 1.0), (1, f"{DAY} 11:00:00", "gone", None),
        (1, f"{DAY} 12:00:00", "now", 1.0), (2, f"{DAY} 12:00:00", "now", 2.0),
        (1, f"{DAY} 12:00:01", "late", 1.0),
    ])
    fields = ["now", "gone", "edge", "old", "late", "now"]
    got = rows(last_value_at(t, f"{DAY} 12:00:00", fields), "as is")
    assert [(m, v) for _, m, v in got] == [
        ("now", 2.0), ("gone", None), ("edge", 1.0), ("old", None), ("late", None), ("now", 2.0)
    ]
    unsorted = rows(last_value_at(t, f"{DAY} 12:00:00", fields, sort=False), "as is")
    assert [m for _, m, _ in unsorted] == ["edge", "gone", "late", "now", "now", "old"]


def test_no_fields(telemetry):
    t = telemetry([(1, f"{DAY} 12:00:00", "a", 1.0)])
    assert rows(last_value_at(t, f"{DAY} 12:00:00", [])) == []


def test_last_known_skips_null_after_picking(telemetry):
    t = telemetry([
        (1, f"{DAY} 10:00:00", "a", 1.0), (1, f"{DAY} 11:00:00", "a", None),
        (1, f"{DAY} 10:00:00", "b", 3.0), (2, f"{DAY} 10:00:00", "b", 4.0),
    ])
    assert [r[1:3] for r in rows(last_known(t, 1))] == [("b", 3.0)]
    assert len(rows(last_known(t))) == 2


def test_period_diff_counts_missing_as_zero(telemetry):
    t = telemetry([
        (1, f"{DAY} 10:00:00", "both", 10.0), (1, f"{DAY} 20:00:00", "both", 25.0),
        (1, f"{DAY} 20:00:00", "finish", 7.0), (1, f"{DAY} 10:00:00", "start", 7.0),
        (2, f"{DAY} 20:30:00", "finish", 8.0),
    ])
    got = rows(period_diff(t, f"{DAY} 12:00:00", f"{DAY} 21:00:00", ["both", "finish", "start", "none"]), "as is")
    assert [(m, v) for _, m, v in got] == [("both", 15.0), ("finish", 8.0), ("start", -7.0), ("none", 0.0)]
    assert {ts for ts, _, _ in got} == {f"{DAY} 21:00:00"}


def test_period_diff_with_overlapping_lookbacks(telemetry):
    t = telemetry([(1, f"{DAY} 10:00:00", "a", 1.0), (1, f"{DAY} 11:30:00", "a", 4.0)])
    got = rows(period_diff(t, f"{DAY} 11:00:00", f"{DAY} 12:00:00", ["a"]))
    assert got[0][2] == 3.0


@pytest.mark.parametrize("buckets", [10_000, 2])
def test_gap_fill(telemetry, monkeypatch, buckets):
    monkeypatch.setattr(series, "CHUNK_BUCKETS", buckets)
    t = telemetry([
        (1, f"{DAY} 09:00:00", "seed", 5.0), (1, f"{DAY} 12:10:00", "seed", 7.0),
        (2, f"{DAY} 12:20:00", "seed", 9.0), (1, f"{DAY} 16:00:00", "seed", 1.0),
        (1, f"{DAY} 09:00:00", "silent", 5.0),
        (1, f"{DAY} 13:00:00", "hole", None), (1, f"{DAY} 10:40:00", "hole", 2.0),
        (1, f"{DAY} 10:20:00", "outside", 2.0), (1, f"{DAY} 15:59:59", "outside", 2.0),
    ])
    got = rows(
        period_values(t, f"{DAY} 10:30:00", f"{DAY} 16:00:00", "1 hour", ["seed", "silent", "hole", "outside"]),
        "as is",
    )
    cells = {}
    for ts, metric, value in got:
        cells.setdefault(metric, []).append((ts[11:13], value))
    assert cells["seed"] == [("10", 5.0), ("11", 5.0), ("12", 8.0), ("13", 8.0), ("14", 8.0), ("15", 8.0), ("16", 1.0)]
    # An observed NULL is carried, as is the value before it.
    assert cells["hole"] == [("10", 2.0), ("11", 2.0), ("12", 2.0), ("13", None), ("14", None), ("15", None)]
    assert cells["outside"] == [("10", 2.0), ("11", 2.0), ("12", 2.0), ("13", 2.0), ("14", 2.0), ("15", 2.0)]
    assert "silent" not in cells
    assert got == sorted(got, key=lambda r: (r[0], ["seed", "silent", "hole", "outside"].index(r[1])))


def test_gap_fill_without_seed_starts_empty(telemetry):
    t = telemetry([(1, f"{DAY} 12:10:00", "a", 7.0)])
    got = rows(period_values(t, f"{DAY} 11:00:00", f"{DAY} 14:00:00", "1 hour", ["a"]))
    assert [v for _, _, v in got] == [None, 7.0, 7.0]


def test_snapshot_ties_unlisted_and_case(telemetry):
    t = telemetry([
        (2, f"{DAY} 10:00:05", "PF(NA)", 2.0), (1, f"{DAY} 10:00:05", "PF(NA)", 1.0),
        (1, f"{DAY} 10:00:04", "vpv1(V)", 9.0), (1, f"{DAY} 10:00:05", "vpv1(V)", None),
        (1, f"{DAY} 10:05:00", "other", 1.0), (1, f"{DAY} 10:06:00", "pf(NA)", 3.0),
    ])
    got = snapshot(t).orderBy("minutets").select("pf", "vpv1").collect()
    assert [tuple(r) for r in got] == [(2.0, None), (None, None), (None, None)]
    loose = snapshot(t, case_insensitive=True).orderBy("minutets").select("pf").collect()
    assert [r["pf"] for r in loose] == [2.0, None, 3.0]
    for width in ("1 hour", "1 month"):
        assert [tuple(r) for r in snapshot(t, width).select("pf", "vpv1").collect()] == [(2.0, None)]
    assert len(snapshot(t, by_device=True).collect()) == 4
    assert rows(snapshot_long(t))[0] == (f"{DAY} 10:00:00", "PF(NA)", 2.0)


def history_rows(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r["time"])]


def test_history_fills_from_exactly_one_row(telemetry):
    t = telemetry([
        (1, f"{DAY} 23:58:00", "vpv1(V)", 1.0), (1, f"{DAY} 23:59:00", "x", 0.0),
        (1, "2024-01-11 00:00:00", "x", 0.0), (1, "2024-01-11 00:01:00", "vpv1(V)", 4.0),
        (1, "2024-01-13 00:01:00", "x", 4.0),
    ])
    one_back = param_history(snapshot(t), DAY, "2024-01-14")
    assert history_rows(one_back, "vpv1") == [1.0, 1.0, None, 4.0, 4.0]
    carried = param_history(snapshot(t), DAY, "2024-01-14", fill="locf")
    assert history_rows(carried, "vpv1") == [1.0, 1.0, 1.0, 4.0, 4.0]
    late = history(t, "2024-01-10 23:59:00", "2024-01-11 00:00:00")
    assert history_rows(late, "vpv1") == [1.0, None]
    newest_first = [r["time"] for r in one_back.collect()]
    assert newest_first == sorted(newest_first, reverse=True)
    cold = param_history(snapshot(t), "2024-01-13", "2024-01-14")
    assert history_rows(cold, "vpv1") == [None]


def test_chunked_fill_equals_one_window(spark, telemetry):
    import random

    random.seed(5)
    data = [
        (1, f"2024-01-{random.randint(1, 9):02} {random.randint(0, 23):02}:{random.randint(0, 59):02}:00",
         random.choice(["vpv1(V)", "vpv2(V)", "x"]), random.choice([None, 1.0, 2.0]))
        for _ in range(300)
    ]
    snap = snapshot(telemetry(list({(d, t, r): (d, t, r, v) for d, t, r, v in data}.values()))).persist()
    snap.createOrReplaceTempView("snap")
    for fill, cell in (
        ("previous_row", "coalesce({0}, lag({0}) OVER (ORDER BY minutets))"),
        ("locf", "last({0}, true) OVER (ORDER BY minutets ROWS UNBOUNDED PRECEDING)"),
    ):
        want = spark.sql(f"SELECT minutets, {cell.format('vpv1')}, {cell.format('vpv2')} FROM snap")
        got = param_history(snap, "2024-01-01", "2024-02-01", fill).select("time", "vpv1", "vpv2")
        assert rows(got) == rows(want)
    snap.unpersist()


def test_history_by_device(telemetry):
    t = telemetry([
        (1, f"{DAY} 10:00:00", "vpv1(V)", 1.0), (2, f"{DAY} 10:01:00", "x", 0.0), (1, f"{DAY} 10:02:00", "x", 0.0),
    ])
    got = param_history(snapshot(t, by_device=True), DAY, "2024-01-11", by_device=True)
    assert {(r["device_id"], r["vpv1"]) for r in got.collect()} == {(1, 1.0), (2, None)}


def test_period_stat_thresholds(telemetry):
    t = telemetry([
        (1, f"{DAY} 10:00:00", "ppv1(W)", 100.0), (1, f"{DAY} 10:01:00", "ppv1(W)", 101.0),
        (1, f"{DAY} 10:00:00", "ppv2(W)", 0.0), (1, f"{DAY} 10:01:00", "ppv2(W)", 0.5),
        (1, f"{DAY} 10:00:00", "pvHistory(kWh)", 3.0), (1, f"{DAY} 10:01:00", "pvHistory(kWh)", 9.0),
        (1, f"{DAY} 10:01:00", "Grid vac1(V)", 230.0),
    ])
    df = period_stat(param_history(snapshot(t), DAY, "2024-01-11"))
    got = df.first()
    assert (got["n_ppv1"], got["x_ppv1"]) == (101.0, 101.0)
    assert (got["n_ppv2"], got["x_ppv2"]) == (0.5, 0.5)
    assert (got["d_pvhistory"], got["x_gridvac1"], got["a_vpv1"]) == (6.0, 230.0, None)
    assert len(df.columns) == 193
    decimal = period_stat(param_history(snapshot(t), DAY, "2024-01-11", decimal=True), decimal=True)
    assert str(decimal.schema["x_ppv1"].dataType) == "DecimalType(38,10)"


def test_bucket_stats(telemetry):
    t = telemetry([
        (1, f"{DAY} 10:00:00", "batteryPower(W)", -500.0), (1, f"{DAY} 11:00:00", "batteryPower(W)", 100.0),
        (1, f"{DAY} 12:00:00", "batteryPower(W)", 200.0), (1, f"{DAY} 10:00:00", "totalUsed(kWh)", 5.0),
        (1, f"{DAY} 22:00:00", "totalUsed(kWh)", 4.0), (1, f"{DAY} 10:00:00", "FaultCode1(NA)", None),
        (1, f"{DAY} 11:00:00", "FaultCode1(NA)", 3.0), (2, f"{DAY} 11:00:00", "unlisted", 3.0),
        (1, f"{DAY} 10:00:00", "genDailyTime(h)", 1.0), (1, f"{DAY} 10:00:00", "heatsinkTemp(C)", 1.0),
    ])
    df = bucket_stats(t)
    assert len(df.columns) == 173
    one, two = df.orderBy("device_id").collect()
    assert (one["n_batterypower"], one["x_batterypower"], one["a_batterypower"]) == (100.0, 200.0, 150.0)
    assert (one["d_totalused"], one["e_totalused"], one["d_gendailytime"]) == (-1.0, 4.0, 0.0)
    assert (one["c_faultcode1"], one["c_faultcode2"], one["x_heatsinktemp"]) == (1, 0, None)
    assert two["c_faultcode1"] == 0 and two["x_batterypower"] is None
    assert bucket_stats(t, "1 hour").count() == 5


def test_night_runs_over_both_pieces(telemetry):
    t = telemetry([
        (1, f"{DAY} 00:10:00", "c", 10.0), (1, f"{DAY} 06:00:00", "c", 12.0), (1, f"{DAY} 07:00:00", "c", 13.0),
        (1, f"{DAY} 22:00:00", "c", 20.0), (1, f"{DAY} 23:30:00", "c", 21.0),
    ])
    stats = tariff_stats(t, ["c"])
    got = {r["zone"]: (r["diff_value"], r["end_value"], r["max_value"], r["min_value"]) for r in stats.collect()}
    assert got == {"night": (11.0, 21.0, 21.0, 10.0), "day": (7.0, 20.0, 20.0, 13.0)}
    assert tariff_report_sum(stats).first()["total_diff"] == 18.0


def make_prices(spark, data):
    raw = spark.createDataFrame(data, "dt string, dprice double, nprice double")
    return raw.withColumn("dt", F.to_timestamp("dt"))


def test_report_costs(spark, telemetry):
    t = telemetry([
        (1, f"{d} {h}:00:00", "c", v) for d in ("2024-01-04", "2024-01-05", "2024-01-06", "2024-03-01")
        for h, v in (("08", 1.0), ("20", 3.0))
    ] + [(1, "2024-01-06 01:00:00", "c", 0.0)])
    prices = make_prices(spark, [
        ("2024-01-05 00:00:00", 4.0, 2.0), ("2024-01-05 12:00:00", 5.0, None), ("2024-01-02 00:00:00", None, 1.0),
    ])
    got = {str(r["day"]): r for r in daily_tariff_report(t, prices, ["c"]).collect()}
    assert [got[d]["day_cost"] for d in sorted(got)] == [None, 8.0, 10.0, 10.0]
    assert got["2024-01-06"]["night_diff"] == 0.0 and got["2024-01-06"]["night_cost"] is None
    assert got["2024-01-06"]["total_diff"] == 2.0 and got["2024-01-05"]["night_diff"] is None


def test_report_without_prices(spark, telemetry):
    t = telemetry([(1, f"{DAY} 08:00:00", "c", 1.0)])
    got = daily_tariff_report(t, make_prices(spark, []), ["c"]).collect()
    assert [(r["day_diff"], r["day_cost"]) for r in got] == [(0.0, None)]


def test_prices_by_day_and_at_an_instant(spark):
    prices = make_prices(spark, [("2024-01-05 12:00:00", 4.0, 2.0), ("2024-01-09 00:00:00", 5.0, 3.0)])
    days = spark.sql("SELECT explode(sequence(date'2024-01-04', date'2024-01-12')) AS day")
    got = {str(r["day"])[8:]: r["d_price"] for r in with_price(days, prices).collect()}
    assert got == {"04": None, "05": None, "06": 4.0, "07": 4.0, "08": 4.0, "09": 5.0, "10": 5.0, "11": 5.0, "12": 5.0}
    assert rows(price_at(prices, F.lit("2024-01-05 12:00:00").cast("timestamp"))) == [(4.0, 2.0)]
    assert rows(price_at(prices, F.lit("2024-01-05 11:00:00").cast("timestamp"))) == []


def test_report_total_as_sum(spark, telemetry):
    t = telemetry([(1, f"{DAY} 01:00:00", "c", 1.0), (1, f"{DAY} 02:00:00", "c", 3.0),
                   (1, f"{DAY} 08:00:00", "c", 4.0), (1, f"{DAY} 09:00:00", "c", 9.0)])
    prices = make_prices(spark, [])
    stats = tariff_stats(t, ["c"])
    assert tariff_report(stats, prices).first()["total_diff"] == 5.0
    assert tariff_report(stats, prices, total="sum").first()["total_diff"] == 7.0
