"""The registered queries in SQL, for DuckDB on the same tables."""

# Nothing here comes from the engine, so that a wrong name or rule shows. The other constants are
# the arguments of the registered queries.
from registered_queries import (
    AT, DIRECTORY, EVENT_TYPES, FIELDS, FINISH, MONTH_END, MONTH_START, NOON, REGISTERS, START,
)

# Registers of the minute table and their columns.
MINUTE_COLUMNS = [line.rsplit(": ", 1) for line in """
aInsidePower(W): ainsidepower
aOutsideCurrent(A): aoutsidecurrent
aOutsidePower(W): aoutsidepower
aPower(W): apower
batChargeToday(kWh): batchargetoday
batChargeTotal(kWh): batchargetotal
batDischargeToday(kWh): batdischargetoday
batDischargeTotal(kWh): batdischargetotal
batteryCurrent(A): batterycurrent
batteryEnergy(%): batteryenergy
batteryPower(W): batterypower
batteryTemp(C): batterytemp
batteryVolt(V): batteryvolt
bInsidePower(W): binsidepower
bOutsideCurrent(A): boutsidecurrent
bOutsidePower(W): boutsidepower
bPower(W): bpower
cInsidePower(W): cinsidepower
cOutsideCurrent(A): coutsidecurrent
cOutsidePower(W): coutsidepower
cPower(W): cpower
dailyUsed(kWh): dailyused
dcTemp(C): dctemp
FaultCode1(NA): faultcode1
FaultCode2(NA): faultcode2
FaultCode3(NA): faultcode3
FaultCode4(NA): faultcode4
genAPower(W): genapower
genAVolt(V): genavolt
genBPower(W): genbpower
genBVolt(V): genbvolt
genCPower(W): gencpower
genCVolt(V): gencvolt
genDailyTime(h): gendailytime
genToday(kWh): gentoday
genTotal(kWh): gentotal
genTotalPower(W): gentotalpower
gridBuyToday(kWh): gridbuytoday
gridBuyTotal(kWh): gridbuytotal
gridFac(Hz): gridfac
gridInsideTotalPac(W): gridinsidetotalpac
gridInsideTotalSac(VA): gridinsidetotalsac
gridOutsideTotalPac(W): gridoutsidetotalpac
gridOutsideTotalSac(VA): gridoutsidetotalsac
gridSellToday(kWh): gridselltoday
gridSellTotal(kWh): gridselltotal
Grid vac1(V): grid_vac1
Grid vac2(V): grid_vac2
Grid vac3(V): grid_vac3
heatsinkTemp(C): heatsinktemp
iac1(A): iac1
iac2(A): iac2
iac3(A): iac3
invACurrent(A): invacurrent
invAPower(W): invapower
invAVolt(V): invavolt
invBCurrent(A): invbcurrent
invBPower(W): invbpower
invBVolt(V): invbvolt
invCCurrent(A): invccurrent
invCPower(W): invcpower
invCVolt(V): invcvolt
invFac(Hz): invfac
invTotalPower(W): invtotalpower
invTotalSac(VA): invtotalsac
ipv1(A): ipv1
ipv2(A): ipv2
loadAPower(W): loadapower
loadAVolt(V): loadavolt
loadBPower(W): loadbpower
loadBVolt(V): loadbvolt
loadCPower(W): loadcpower
loadCVolt(V): loadcvolt
loadTotalPac(W): loadtotalpac
loadTotalSac(VA): loadtotalsac
PF(NA): pf
ppv1(W): ppv1
ppv2(W): ppv2
pvEToday(kWh): pvetoday
pvHistory(kWh): pvhistory
todayPv1(kWh): todaypv1
todayPv2(kWh): todaypv2
todayPv3(kWh): todaypv3
todayPv4(kWh): todaypv4
totalUsed(kWh): totalused
upsLoadAPower(W): upsloadapower
upsLoadBPower(W): upsloadbpower
upsLoadCPower(W): upsloadcpower
upsLoadTotalPower(W): upsloadtotalpower
vpv1(V): vpv1
vpv2(V): vpv2
""".strip().splitlines()]

# The counters that tariff statistics are kept for.
TARIFF = [name.strip() for name in """
batChargeTotal(kWh), batDischargeTotal(kWh), dailyUsed(kWh), genTotal(kWh), gridBuyTotal(kWh),
gridSellTotal(kWh), pvHistory(kWh), todayPv1(kWh), todayPv2(kWh), totalUsed(kWh)
""".split(",")]

# Register, end of the column names, statistics of a bucket.
DAY_STATISTICS = """
aInsidePower(W): ainsidepower min>=100 max avg>=100
aOutsidePower(W): aoutsidepower min>=100 max avg>=100
batChargeTotal(kWh): batchargetotal delta end
batDischargeTotal(kWh): batdischargetotal delta end
batteryEnergy(%): batteryenergy min max avg
batteryPower(W): batterypower min>=100 max avg>=100
batteryTemp(C): batterytemp min max avg
batteryVolt(V): batteryvolt min>=100 max avg>=100
bInsidePower(W): binsidepower min>=100 max avg>=100
bOutsidePower(W): boutsidepower min>=100 max avg>=100
cInsidePower(W): cinsidepower min>=100 max avg>=100
dailyUsed(kWh): dailyused delta end
dcTemp(C): dctemp min max avg
heatSinkTemp(C): heatsinktemp min max avg
FaultCode1(NA): faultcode1 count
FaultCode2(NA): faultcode2 count
FaultCode3(NA): faultcode3 count
FaultCode4(NA): faultcode4 count
genAPower(W): genapower min>=100 max avg>=100
genAVolt(V): genavolt min>=100 max avg>=100
genBPower(W): genbpower min>=100 max avg>=100
genBVolt(V): genbvolt min>=100 max avg>=100
genCPower(W): gencpower min>=100 max avg>=100
genCVolt(V): gencvolt min>=100 max avg>=100
genTotal(kWh): gentotal delta end
genDailyTime(h): gendailytime delta
genTotalPower(W): gentotalpower min>=100 max avg>=100
gridInsideTotalPac(W): gridinsidetotalpac min>=100 max avg>=100
gridOutsideTotalPac(W): gridoutsidetotalpac min>=100 max avg>=100
gridInsideTotalSac(VA): gridinsidetotalsac min>=100 max avg>=100
gridOutsideTotalSac(VA): gridoutsidetotalsac min>=100 max avg>=100
Grid vac1(V): gridvac1 min>=100 max avg>=100
Grid vac2(V): gridvac2 min>=100 max avg>=100
Grid vac3(V): gridvac3 min>=100 max avg>=100
gridBuyTotal(kWh): gridbuytotal delta end
gridSellTotal(kWh): gridselltotal delta end
gridFac(Hz): gridfac min max avg
invFac(Hz): invfac min max avg
invAPower(W): invapower min>=100 max avg>=100
invAVolt(V): invavolt min>=100 max avg>=100
invBPower(W): invbpower min>=100 max avg>=100
invBVolt(V): invbvolt min>=100 max avg>=100
invCPower(W): invcpower min>=100 max avg>=100
invCVolt(V): invcvolt min>=100 max avg>=100
invTotalPower(W): invtotalpower min>=100 max avg>=100
invTotalSac(VA): invtotalsac min>=100 max avg>=100
loadAPower(W): loadapower min>=100 max avg>=100
loadAVolt(V): loadavolt min>=100 max avg>=100
loadBPower(W): loadbpower min>=100 max avg>=100
loadBVolt(V): loadbvolt min>=100 max avg>=100
loadCPower(W): loadcpower min>=100 max avg>=100
loadCVolt(V): loadcvolt min>=100 max avg>=100
ipv1(A): ipv1 min max
vpv1(V): vpv1 min>=100 avg>=100
ppv1(W): ppv1 min>=100 max avg>=100
ipv2(A): ipv2 min max
vpv2(V): vpv2 min>=100 avg>=100
ppv2(W): ppv2 min>=100 max avg>=100
pvHistory(kWh): pvhistory delta end
todayPv1(kWh): todaypv1 delta end
todayPv2(kWh): todaypv2 delta end
loadTotalPac(W): loadtotalpac min>=100 max avg>=100
loadTotalSac(VA): loadtotalsac min>=100 max avg>=100
pf(NA): pf min max avg
totalUsed(kWh): totalused delta end
"""

# Column of the minute history, end of the column names, statistics of a period.
PERIOD_STATISTICS = """
aInsidePower: ainsidepower max
aOutsideCurrent: aoutsidecurrent max
aOutsidePower: aoutsidepower max avg
aPower: apower max avg
batChargeToday: batchargetoday range
batChargeTotal: batchargetotal range min avg
batDischargeToday: batdischargetoday min avg
batDischargeTotal: batdischargetotal max
batDischargeToday: batdischargetoday range
batDischargeTotal: batdischargetotal range
batteryCurrent: batterycurrent max
batteryEnergy: batteryenergy max min avg
batteryPower: batterypower max avg
batteryTemp: batterytemp max min avg
batteryVolt: batteryvolt max min avg
bInsidePower: binsidepower max
bOutsideCurrent: boutsidecurrent max
bOutsidePower: boutsidepower max avg
bPower: bpower max avg
cInsidePower: cinsidepower max avg
cOutsideCurrent: coutsidecurrent max
cOutsidePower: coutsidepower max avg
cPower: cpower max avg
dailyUsed: dailyused max avg
dcTemp: dctemp max avg min
genAPower: genapower max avg
genAVolt: genavolt min>100 max
genBPower: genbpower avg
genBVolt: genbvolt min>100 max avg
genCPower: gencpower max avg
genCVolt: gencvolt min>100 max avg
genDailyTime: gendailytime avg
genToday: gentoday max avg
genTotal: gentotal range max avg
genTotalPower: gentotalpower max avg
gridBuyToday: gridbuytoday range min avg max
gridBuyTotal: gridbuytotal range
gridFac: gridfac avg min max
gridInsideTotalPac: gridinsidetotalpac max avg
gridInsideTotalSac: gridinsidetotalsac max avg
gridOutsideTotalPac: gridoutsidetotalpac max avg
gridOutsideTotalSac: gridoutsidetotalsac max avg
gridSellToday: gridselltoday range min avg max
gridSellTotal: gridselltotal range
grid_Vac1: gridvac1 max min>100
grid_Vac2: gridvac2 max min>100
grid_Vac3: gridvac3 max min>100
heatSinkTemp: heatsinktemp max min avg
iac1: iac1 max min avg
iac2: iac2 max min avg
iac3: iac3 max min avg
invACurrent: invacurrent max min avg
invAPower: invapower max min avg
invAVolt: invavolt max min>100
invBCurrent: invbcurrent max min avg
invBPower: invbpower max min avg
invBVolt: invbvolt max min>100 avg
invCCurrent: invccurrent max min avg
invCPower: invcpower max min avg
invCVolt: invcvolt max min>100 avg
invFac: invfac max min avg
invTotalPower: invtotalpower max min avg
invTotalSac: invtotalsac max min avg
ipv1: ipv1 max min avg
ipv2: ipv2 max min avg
loadAPower: loadapower max min avg
loadAVolt: loadavolt max min>100 avg
loadBPower: loadbpower max min avg
loadBVolt: loadbvolt max min>100 avg
loadCPower: loadcpower max min avg
loadCVolt: loadcvolt max min>100 avg
loadTotalPac: loadtotalpac max min avg
loadTotalSac: loadtotalsac max min avg
pf: pf max min avg
ppv1: ppv1 max min>100
ppv2: ppv2 max min>0
pvEtoday: pvetoday max min>0
pvHistory: pvhistory range
todayPv1: todaypv1 max min>0
todayPv2: todaypv2 max min>0
totalUsed: totalused range min avg
vpv1: vpv1 max min>0 avg
vpv2: vpv2 max min>0 avg
"""
LETTER = {"min": "n", "max": "x", "avg": "a", "count": "c", "range": "d", "delta": "d", "end": "e"}
NAMES = [register for register, _ in MINUTE_COLUMNS] + ["heatSinkTemp(C)", "pf(NA)", "unlisted(NA)"]


def statistics_of(text):
    """(source, statistic, column) of a list of statistics."""
    for line in text.strip().splitlines():
        source, _, rest = line.rpartition(": ")
        stem, *stats = rest.split(" ")
        for stat in stats:
            yield source, stat, f"{LETTER[stat.split('>')[0]]}_{stem}"


PRICES = """VALUES (TIMESTAMP '2024-01-05 00:00:00', 4.0::DOUBLE, 2.0::DOUBLE),
    (TIMESTAMP '2024-01-15 00:00:00', 5.0, 2.5), (TIMESTAMP '2024-01-24 18:00:00', 6.0, 3.0)"""


def text_list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def in_list(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


# Inputs ---------------------------------------------------------------------------------------

GAUGES = """gauges AS (SELECT event_id AS id, (1 + user_id % 4)::INT AS device_id,
    ts AS "timestamp", event_type AS register_name, value FROM events)"""
COUNTERS = """gauges AS (SELECT event_id AS id, (1 + user_id % 4)::INT AS device_id,
    ts AS "timestamp", event_type AS register_name, event_id * 0.5::DOUBLE AS value FROM events)"""
STEPS = """gauges AS (SELECT event_id AS id, (1 + user_id % 4)::INT AS device_id,
    ts AS "timestamp", event_type AS register_name, floor(value / 50) * 50.0::DOUBLE AS value
    FROM events)"""
NAMED = f"""gauges AS (SELECT event_id AS id, (1 + user_id % 4)::INT AS device_id,
    ts AS "timestamp", {text_list(NAMES)}[event_id % {len(NAMES)} + 1] AS register_name, value
    FROM events)"""
METER = f"""meter AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_suppkey % 4 + 1)::INT AS device_id,
    make_timestamp(epoch_us(l_shipdate) + ((l_orderkey * 7919) % 86400) * 1000000 + l_linenumber * 1000)
        AS "timestamp",
    {text_list(NAMES)}[l_partkey % {len(NAMES)} + 1] AS register_name,
    CASE WHEN l_tax < 0.075 THEN l_quantity * 4 END AS value FROM lineitem)"""
FRAMES = f"""frames AS (SELECT (l_suppkey % 4 + 1)::INT AS device_id, l_shipdate AS ts,
    l_orderkey * 8 + l_linenumber AS frame_id, l_orderkey, l_linenumber,
    [(l_partkey * 31) % 65536, (l_orderkey * 7919) % 65536, floor(l_quantity)::BIGINT,
     floor(l_extendedprice)::BIGINT % 65536, l_linenumber::BIGINT,
     floor(l_extendedprice)::BIGINT // 65536] AS w FROM lineitem),
registers AS (SELECT * FROM ({REGISTERS}) t(address, name, type, scale, preprocessing, enabled, register_no))"""
PART_REGISTERS = """registers AS (SELECT (p_partkey // 40)::INT AS device_id,
    (p_partkey % 40)::INT AS register_no, ((p_partkey * 37) % 500)::INT AS address,
    p_brand || '-' || p_partkey AS name,
    ['int16', 'uint16', 'int32', 'uint32', 'float32', 'uint64'][p_size % 6 + 1] AS type,
    ['holding', 'input'][p_partkey % 2 + 1] AS reg_type,
    CASE WHEN p_size % 3 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS scale,
    p_partkey % 11 <> 0 AS enabled FROM part),
devices AS (SELECT DISTINCT (p_partkey // 40)::INT AS id, (p_partkey // 40) % 3 <> 0 AS is_zero,
    (p_partkey // 40) % 5 <> 0 AS enabled FROM part)"""
PART_RANGES = """ranges AS (SELECT (p_partkey // 20)::INT AS device_id, p_partkey AS range_no,
    ((p_partkey * 37) % 1000)::INT AS start, (p_size - 1)::INT AS "count" FROM part)"""
ORDER_PRICES = """prices AS (SELECT o_orderdate + to_seconds(floor(o_totalprice)::BIGINT % 86400) AS dt,
    max(o_totalprice) AS dprice, min(o_totalprice) AS nprice FROM orders GROUP BY 1)"""
FIXED_PRICES = f"prices AS (SELECT * FROM ({PRICES}) t(dt, dprice, nprice))"
FIELD_LIST = f"""fields AS (SELECT unnest({text_list(FIELDS)}) AS register_name,
    generate_subscripts({text_list(FIELDS)}, 1) AS nr),
directory AS (SELECT * FROM ({DIRECTORY}) t(register_name, friendly, unit)),
named AS (SELECT f.register_name, f.nr, coalesce(d.friendly, f.register_name) AS friendly,
    coalesce(d.friendly, f.register_name)
        || CASE WHEN d.unit <> '' THEN ' (' || d.unit || ')' ELSE '' END AS with_unit
    FROM fields f LEFT JOIN directory d USING (register_name))"""


def newest(rows, where):
    return f"""SELECT register_name, value FROM (SELECT *, row_number() OVER (PARTITION BY register_name
        ORDER BY "timestamp" DESC, device_id DESC) AS rn FROM {rows} WHERE {where}) WHERE rn = 1"""


def lookback(ts, strict=False):
    top = "<" if strict else "<="
    return f""""timestamp" {top} TIMESTAMP '{ts}' AND "timestamp" >= TIMESTAMP '{ts}' - INTERVAL 4 HOURS"""


def last_value(name):
    return f"""WITH {GAUGES}, {FIELD_LIST}, latest AS ({newest("gauges", lookback(AT))})
    SELECT TIMESTAMP '{AT}' AS metricts, {name} AS metric, l.value
    FROM named n LEFT JOIN latest l USING (register_name)"""


def period_diff(name):
    return f"""WITH {COUNTERS}, {FIELD_LIST}, s AS ({newest("gauges", lookback(START))}),
    f AS ({newest("gauges", lookback(FINISH))})
    SELECT TIMESTAMP '{FINISH}' AS metricts, {name} AS metric,
        coalesce(f.value, 0) - coalesce(s.value, 0) AS value
    FROM named n LEFT JOIN s USING (register_name) LEFT JOIN f USING (register_name)"""


def period_values(start, finish, width, name, rows=GAUGES, table="gauges", fields=None):
    """An observed bucket counts from its start until the next one, also when its average is NULL."""
    origin = "TIMESTAMP '2000-01-03'"
    return f"""WITH {rows}, {fields or FIELD_LIST},
    seen AS (SELECT time_bucket(INTERVAL '{width}', "timestamp", {origin}) AS bucket, register_name,
        avg(value) AS value FROM {table} WHERE "timestamp" BETWEEN '{start}' AND '{finish}'
        AND register_name IN (SELECT register_name FROM fields) GROUP BY ALL),
    slots AS (SELECT unnest(generate_series(time_bucket(INTERVAL '{width}', TIMESTAMP '{start}', {origin}),
        TIMESTAMP '{finish}' - INTERVAL 1 MICROSECOND, INTERVAL '{width}')) AS bucket),
    grid AS (SELECT bucket, register_name FROM slots, (SELECT DISTINCT register_name FROM seen)
        UNION SELECT bucket, register_name FROM seen),
    before AS ({newest(table, lookback(start, True))}),
    filled AS (SELECT g.bucket, g.register_name, CASE WHEN s.bucket IS NULL THEN b.value ELSE s.value END AS value
        FROM grid g ASOF LEFT JOIN seen s ON g.register_name = s.register_name AND g.bucket >= s.bucket
        LEFT JOIN before b ON b.register_name = g.register_name)
    SELECT bucket AS metricts, {name} AS metric, round(value, 8) AS value
    FROM filled JOIN named n USING (register_name)"""


def pivot_last(rows, key, keys, order):
    cells = ",\n".join(
        f"""arg_max_null(value, {order}) FILTER (WHERE register_name = '{r}') AS "{c}\""""
        for r, c in MINUTE_COLUMNS
    )
    return f"SELECT {key}, {cells} FROM {rows} GROUP BY {keys}"


WIDE = [column for _, column in MINUTE_COLUMNS]
# Time and device as one number, for ties between devices.
BY_TIME_AND_DEVICE = 'epoch_us("timestamp") * 10 + device_id'
MINUTE = "date_trunc('minute', \"timestamp\")"
SNAP = f"snap AS ({pivot_last('gauges', MINUTE + ' AS minutets', '1', BY_TIME_AND_DEVICE)})"
SNAP_METER = SNAP.replace("FROM gauges", "FROM meter")
SNAP_DEVICE = "snap AS (" + pivot_last(
    "gauges", MINUTE + " AS minutets, device_id", "1, 2", 'epoch_us("timestamp")'
) + ")"


def history(fill, partition="", keys=""):
    over = f'OVER ({partition} ORDER BY minutets'
    cell = {
        "previous_row": f'coalesce("{{0}}", lag("{{0}}") {over})) AS "{{0}}"',
        "locf": f'last_value("{{0}}" IGNORE NULLS) {over} ROWS UNBOUNDED PRECEDING) AS "{{0}}"',
    }[fill]
    return f"SELECT minutets AS time, {keys} {', '.join(cell.format(c) for c in WIDE)} FROM snap"


def stat_sql(stat, value, order="epoch_us(\"timestamp\")", where=None):
    kind, _, limit = stat.partition(">")
    tests = [t for t in (where, limit and f"{value} >{limit}") if t]
    test = f" FILTER (WHERE {' AND '.join(tests)})" if tests else ""
    if kind == "range":
        return f"max({value}){test} - min({value}){test}"
    if kind == "end":
        return f"arg_max_null({value}, {order}){test}"
    if kind == "delta":
        return f"arg_max_null({value}, {order}){test} - arg_min_null({value}, {order}){test}"
    return f"{kind}({value}){test}"


def period_stat(rounding):
    have = set(WIDE)
    cells = []
    for source, stat, column in statistics_of(PERIOD_STATISTICS):
        value = stat_sql(stat, f'"{source.lower()}"') if source.lower() in have else "NULL::DOUBLE"
        if rounding and column.startswith("a_"):
            value = f"round({value}, 8)"
        cells.append(f"{value} AS {column}")
    return f"SELECT {', '.join(cells)} FROM history"


def bucket_stats(rows, width, rounding=False):
    cells = []
    for source, stat, column in statistics_of(DAY_STATISTICS):
        value = stat_sql(stat, "value", where=f"register_name = '{source}'")
        if rounding and column.startswith("a_"):
            value = f"round({value}, 8)"
        cells.append(f"{value} AS {column}")
    return f"""SELECT date_trunc('{width}', "timestamp") AS metricts, device_id, {', '.join(cells)}
        FROM {rows} GROUP BY 1, 2"""


def tariff_stats(rows, registers):
    return f"""SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, device_id, register_name,
        CASE WHEN hour("timestamp") >= 23 OR hour("timestamp") < 7 THEN 'night' ELSE 'day' END AS zone,
        arg_max_null(value, "timestamp") - arg_min_null(value, "timestamp") AS diff_value,
        arg_max_null(value, "timestamp") AS end_value, max(value) AS max_value, min(value) AS min_value
    FROM {rows} WHERE register_name IN {in_list(registers)} GROUP BY 1, 2, 3, 4"""


TARIFF_REPORT = """SELECT day, device_id, register_name, day_diff, day_diff * dprice AS day_cost,
        night_diff, night_diff * nprice AS night_cost, total_diff
    FROM (SELECT day::DATE AS day, device_id, register_name,
        max(diff_value) FILTER (WHERE zone = 'day') AS day_diff,
        max(diff_value) FILTER (WHERE zone = 'night') AS night_diff, max(diff_value) AS total_diff
        FROM stats GROUP BY 1, 2, 3) s ASOF LEFT JOIN prices p ON s.day::TIMESTAMP >= p.dt"""


def stream_snapshot(width):
    """Buckets that the watermark has passed at the end."""
    return f"""WITH {GAUGES}, m AS (SELECT time_bucket(INTERVAL '{width}', "timestamp", TIMESTAMP '2000-01-03') AS minutets,
            register_name, arg_max_null(value, {BY_TIME_AND_DEVICE}) AS value FROM gauges GROUP BY 1, 2)
        SELECT * FROM m WHERE minutets + INTERVAL '{width}' <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)"""


# Value of a register's words ``a b c d`` by type, and its preprocessed form.
DECODED = """CASE type WHEN 'uint16' THEN a::DOUBLE
    WHEN 'int16' THEN (CASE WHEN a >= 32768 THEN a - 65536 ELSE a END)::DOUBLE
    WHEN 'uint32' THEN (a + b * 65536)::DOUBLE
    WHEN 'int32' THEN (CASE WHEN b >= 32768 THEN a + b * 65536 - 4294967296 ELSE a + b * 65536 END)::DOUBLE
    WHEN 'uint64' THEN (a::HUGEINT + b::HUGEINT * 65536 + c::HUGEINT * 4294967296
        + d::HUGEINT * 281474976710656)::DOUBLE
    WHEN 'float32' THEN (CASE WHEN b >= 32768 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * CASE
        WHEN (b // 128) % 256 = 255 THEN
            CASE WHEN (b % 128) * 65536 + a = 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END
        WHEN (b // 128) % 256 = 0 THEN ((b % 128) * 65536 + a) * pow(2.0::DOUBLE, -149)
        ELSE (8388608 + (b % 128) * 65536 + a) * pow(2.0::DOUBLE, (b // 128) % 256 - 150) END END"""
WORD_COUNT = "CASE WHEN type IN ('int32', 'uint32', 'float32') THEN 2 WHEN type = 'uint64' THEN 4 ELSE 1 END"


def precision(value):
    whole = f"round({value})::BIGINT"
    return f"""CASE WHEN {whole} > 0 THEN
        ({whole} % pow(10, length({whole}::VARCHAR) - 1)::BIGINT)::DOUBLE
        * pow(10.0::DOUBLE, -left({whole}::VARCHAR, 1)::INT) ELSE {value} END"""


FITS = f"address - 500 + {WORD_COUNT} <= 6"
READ = f"""hits AS (SELECT frame_id, device_id, ts, address, name, type, scale, preprocessing, register_no,
    w[address - 499] AS a, w[address - 498] AS b, w[address - 497] AS c, w[address - 496] AS d
    FROM frames, registers WHERE enabled AND address BETWEEN 500 AND 505 AND {FITS}),
decoded AS (SELECT *, {DECODED} AS raw FROM hits),
scaled AS (SELECT *, raw * scale::DOUBLE AS scaled FROM decoded),
readings AS (SELECT frame_id, device_id, ts, address, name, type,
    trunc(CASE WHEN isfinite(raw) AND abs(raw) < 9.3e18 THEN raw END)::HUGEINT AS whole,
    CASE WHEN preprocessing THEN round({precision("scaled")}, 10) ELSE scaled END AS value FROM scaled)"""

# Greedy chain per series: each row is tested against the last one kept. Ids repeat (two lines of an order can
# have one number), so rows of one time and id go by value.
CHAIN = """ordered AS (SELECT *, row_number() OVER (PARTITION BY device_id, register_name
    ORDER BY "timestamp", id, value) AS rn FROM gauges),
walk(id, device_id, register_name, rn, keep, kept_t, kept_v) AS (
    SELECT id, device_id, register_name, rn, TRUE, "timestamp", value FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.id, o.device_id, o.register_name, o.rn,
        abs(o.value - w.kept_v) >= {eps} OR o."timestamp" - w.kept_t >= {hold},
        CASE WHEN abs(o.value - w.kept_v) >= {eps} OR o."timestamp" - w.kept_t >= {hold}
            THEN o."timestamp" ELSE w.kept_t END,
        CASE WHEN abs(o.value - w.kept_v) >= {eps} OR o."timestamp" - w.kept_t >= {hold}
            THEN o.value ELSE w.kept_v END
    FROM walk w JOIN ordered o ON o.device_id = w.device_id AND o.register_name = w.register_name
        AND o.rn = w.rn + 1)
SELECT o.id, o.device_id, o."timestamp", o.register_name, o.value FROM ordered o
JOIN walk w USING (device_id, register_name, rn) WHERE w.keep"""


def deadband(source, eps, hold):
    return f"WITH RECURSIVE {source}, {CHAIN.format(eps=eps, hold=hold)}"


# Frames over the seconds of their day. A value that is two deadbands away from the one before is kept, as the
# last kept one lies within a deadband of that; so each run up to such a value is walked as a series of its own.
SPREAD = FRAMES.replace(
    "l_shipdate AS ts", "l_shipdate + to_seconds(((l_orderkey * 8 + l_linenumber) * 7919) % 86400) AS ts")
RUNS = CHAIN.format(eps=1e-9, hold="INTERVAL 30 HOURS").replace(
    "o.register_name, o.value FROM", "split_part(o.register_name, '#', 1) AS register_name, o.value FROM")
INGEST = f"""WITH RECURSIVE {SPREAD}, {READ},
in_order AS (SELECT *, row_number() OVER w AS place, lag(scaled) OVER w AS previous FROM scaled
    WINDOW w AS (PARTITION BY device_id, name ORDER BY ts, frame_id, scaled)),
runs AS (SELECT *, sum(CASE WHEN abs(scaled - previous) < 2e-9 THEN 0 ELSE 1 END) OVER (
    PARTITION BY device_id, name ORDER BY place) AS run FROM in_order),
gauges AS (SELECT frame_id AS id, device_id, ts AS "timestamp", name || '#' || run AS register_name,
    scaled AS value FROM runs),
{RUNS.replace(")\nSELECT o.id, o.device_id, o.\"timestamp\"", "),\nstored AS (SELECT o.id, o.device_id, o.\"timestamp\"")})"""

# The same frames within six weeks. A second start goes on from the last stored reading, so it changes nothing.
INGEST_WEEKS = INGEST.replace(SPREAD, FRAMES.replace("l_shipdate AS ts", """TIMESTAMP '2024-01-01' + to_milliseconds(
    date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 1440000 + ((l_orderkey * 8 + l_linenumber) * 7919) % 1440000)
    AS ts"""))

FIRST_OF_KEY = """SELECT min(id) AS id, device_id, "timestamp", register_name, first(value ORDER BY id, value) AS value
    FROM stored GROUP BY 2, 3, 4"""

EXPORTS = """wide AS (SELECT l_suppkey::VARCHAR AS file,
    (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS line_no,
    CASE WHEN l_quantity > 2 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') ELSE ' ' END AS "Time",
    l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem),
kept AS (SELECT * FROM wide WHERE trim("Time") <> '' AND (q <> 0 OR d <> 0 OR t <> 0)),
long AS (SELECT file, line_no, "Time", 'quantity(n)' AS register_name, q AS value FROM kept
    UNION ALL SELECT file, line_no, "Time", 'discount(%)', d FROM kept
    UNION ALL SELECT file, line_no, "Time", 'tax(C)', t FROM kept
    UNION ALL SELECT file, line_no, "Time", 'flag(NA)', NULL FROM kept)"""
IMPORTED = f"""{EXPORTS},
moves AS (SELECT *, lag(value) OVER (PARTITION BY file, register_name ORDER BY "Time", line_no) AS previous
    FROM long),
imported AS (SELECT epoch("Time"::TIMESTAMP)::BIGINT AS id, 1 AS device_id, "Time"::TIMESTAMP AS "timestamp",
    register_name, value, file FROM moves
    WHERE (previous IS NULL OR value <> previous) AND value IS NOT NULL AND value <> 0)"""

# Column, value, and storage type as the catalog of the wide table gives it.
WIDE_COLUMNS = [
    ("quantity", "l_quantity", "INTEGER"), ("price", "l_extendedprice", "DECIMAL(6,2)"),
    ("part", "l_partkey * 1e8", "INTEGER"), ("order", "l_orderkey * 1e15", "DECIMAL(20,0)"),
    ("tax", "CASE WHEN l_linenumber > 1 THEN l_tax END", "DOUBLE"), ("total", "l_suppkey * 25e6", "DECIMAL(10,2)"),
]
LINE_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
WIDE_TYPED = ", ".join(
    f"""TRY_CAST(({v})::DOUBLE AS {t}){"::VARCHAR" if t.startswith("DECIMAL") else ""} AS "{c}\"""" for c, v, t in WIDE_COLUMNS)
WIDE_REJECTS = " UNION ALL ".join(
    f"""SELECT {LINE_KEYS}, '{c}' AS column_name, ({v})::DOUBLE AS value, '{t}' AS column_type FROM lineitem
        WHERE ({v}) IS NOT NULL AND TRY_CAST(({v})::DOUBLE AS {t}) IS NULL""" for c, v, t in WIDE_COLUMNS)
SPARK_NAMES = {"INTEGER": "int"}
# Type in a file of the first age, where all are doubles, and of the second, which lacks the price.
DRIFT = " UNION ALL ".join(
    f"""SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month, '{c}' AS column_name, {now} AS current_type,
        '{SPARK_NAMES.get(t, t.lower())}' AS expected_type FROM lineitem WHERE {when}"""
    for c, _, t in WIDE_COLUMNS
    for now, when in [
        ("'double'", "l_shipdate < DATE '1997-01-01'"),
        ("NULL", "l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1999-01-01'"),
    ]
    if t != "DOUBLE" and (now != "NULL" or c == "price"))

CONFIGS = """r AS (SELECT p_partkey AS k, (p_partkey // 40)::INT AS device_id,
    (p_partkey % 40)::INT AS register_no FROM part),
d AS (SELECT DISTINCT device_id AS id FROM r)"""

RESOLVE = f"""{PART_REGISTERS},
specs AS (SELECT (p_partkey // 40)::INT AS device_id, p_partkey AS spec_no,
    ((p_partkey * 37) % 500)::INT AS a FROM part),
asked AS (
    SELECT device_id, spec_no, x AS pos, a + x AS address FROM specs, (SELECT unnest(range(5)) AS x)
        WHERE spec_no % 5 = 0
    UNION ALL SELECT device_id, spec_no, x, a + 4 * x FROM specs, (SELECT unnest(range(2)) AS x)
        WHERE spec_no % 5 = 1
    UNION ALL SELECT device_id, spec_no, 0, a FROM specs WHERE spec_no % 5 = 3),
defined AS (SELECT * FROM registers QUALIFY row_number() OVER (
    PARTITION BY device_id, address ORDER BY register_no DESC) = 1)"""

WIRED = f"""{PART_REGISTERS},
wired AS (SELECT r.*, CASE WHEN is_zero THEN address ELSE greatest(address - 1, 0) END AS wire_address,
    {WORD_COUNT} AS words FROM registers r JOIN devices d ON d.id = r.device_id WHERE r.enabled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id, reg_type ORDER BY wire_address, words) AS rn
    FROM (SELECT DISTINCT device_id, reg_type, wire_address, words FROM wired)),
pack(device_id, reg_type, wire_address, words, rn, frame_no, frame_start) AS (
    SELECT device_id, reg_type, wire_address, words, rn, 0, wire_address FROM ranked WHERE rn = 1
    UNION ALL
    SELECT n.device_id, n.reg_type, n.wire_address, n.words, n.rn,
        p.frame_no + (n.wire_address + n.words - p.frame_start > 100)::INT,
        CASE WHEN n.wire_address + n.words - p.frame_start > 100 THEN n.wire_address ELSE p.frame_start END
    FROM pack p JOIN ranked n ON n.device_id = p.device_id AND n.reg_type = p.reg_type AND n.rn = p.rn + 1),
planned AS (SELECT w.device_id, w.reg_type, w.register_no, w.wire_address, w.words, p.frame_no, p.frame_start
    FROM wired w JOIN pack p USING (device_id, reg_type, wire_address, words))"""

WINDOWED = "day >= TIMESTAMP '2024-01-12' AND day < TIMESTAMP '2024-01-25'"

SQL = {
    "last_value_at": last_value("n.register_name"),
    "last_value_at_friendly": last_value("n.with_unit"),
    "last_known": f"""WITH {METER} SELECT device_id, register_name, value, "timestamp" FROM (
        SELECT *, row_number() OVER (PARTITION BY device_id, register_name ORDER BY "timestamp" DESC) AS rn
        FROM meter) WHERE rn = 1 AND value IS NOT NULL""",
    "last_known_device": f"""WITH {METER} SELECT device_id, register_name, value, "timestamp" FROM (
        SELECT *, row_number() OVER (PARTITION BY register_name ORDER BY "timestamp" DESC) AS rn
        FROM meter WHERE device_id = 2) WHERE rn = 1 AND value IS NOT NULL""",
    "distinct_registers": f"WITH {METER} SELECT DISTINCT register_name FROM meter",
    "row_count": "SELECT count(*) AS n_rows FROM lineitem",
    "period_diff": period_diff("n.register_name"),
    "period_diff_friendly": period_diff("n.with_unit"),
    "period_values": period_values(START, FINISH, "5 hours", "n.register_name"),
    "period_values_hourly": period_values(MONTH_START, MONTH_END, "1 hour", "n.friendly"),
    "period_values_second": period_values(START, NOON, "1 second", "n.register_name"),
    "period_values_meter": period_values(
        "1996-01-01 00:00:00", "1997-01-01 00:00:00", "1 day", "n.register_name", METER, "meter",
        f"""fields AS (SELECT unnest({text_list(TARIFF)}) AS register_name),
        named AS (SELECT register_name FROM fields)"""),
    "period_avg": f"""WITH {GAUGES} SELECT date_trunc('day', "timestamp")::TIMESTAMP AS bucket, register_name,
        round(avg(value), 8) AS value FROM gauges GROUP BY 1, 2""",
    "time_bucket": f"""WITH {GAUGES} SELECT time_bucket(INTERVAL 7 DAYS, "timestamp", TIMESTAMP '2000-01-03') AS week,
        time_bucket(INTERVAL 5 HOURS, "timestamp", TIMESTAMP '2000-01-03') AS hours,
        date_trunc('month', "timestamp")::TIMESTAMP AS month, count(*) AS n FROM gauges GROUP BY 1, 2, 3""",
    "tariff_zone": f"""WITH {GAUGES}, z AS (SELECT *, hour("timestamp") AS h,
            hour("timestamp" + INTERVAL 2 HOURS) AS k FROM gauges)
        SELECT id, CASE WHEN h >= 23 OR h < 7 THEN 'night' ELSE 'day' END AS zone,
        CASE WHEN k >= 23 OR k < 7 THEN 'night' ELSE 'day' END AS zone_local,
        strftime(date_trunc('millisecond', "timestamp"), '%Y-%m-%d %H:%M:%S.%g') || '+00' AS stored_as FROM z""",
    "tariff_stats": f"WITH {COUNTERS} {tariff_stats('gauges', EVENT_TYPES)}",
    "tariff_stats_meter": f"WITH {METER} {tariff_stats('meter', TARIFF)}",
    "tariff_report": f"""WITH {COUNTERS}, {FIXED_PRICES}, stats AS ({tariff_stats('gauges', EVENT_TYPES)})
        {TARIFF_REPORT}""",
    "tariff_report_meter": f"""WITH {METER}, {ORDER_PRICES}, stats AS ({tariff_stats('meter', TARIFF)})
        {TARIFF_REPORT}""",
    "tariff_report_sum": f"""WITH {COUNTERS}, stats AS ({tariff_stats('gauges', EVENT_TYPES)})
        SELECT day, device_id, register_name, max(diff_value) FILTER (WHERE zone = 'day') AS day_diff,
        max(diff_value) FILTER (WHERE zone = 'night') AS night_diff, sum(diff_value) AS total_diff
        FROM stats GROUP BY 1, 2, 3""",
    "price_asof": f"""WITH {ORDER_PRICES}, days AS (SELECT ts::DATE AS day FROM events
            UNION SELECT l_shipdate::DATE FROM lineitem)
        SELECT day, dprice AS d_price, nprice AS n_price
        FROM days ASOF LEFT JOIN prices ON days.day::TIMESTAMP >= prices.dt""",
    "snapshot_1m": f"WITH {METER}, {SNAP_METER} SELECT * FROM snap",
    "snapshot_1d": f"""WITH {METER}, {SNAP_METER.replace("'minute'", "'day'")} SELECT * FROM snap""",
    "snapshot_by_device": f"WITH {NAMED}, {SNAP_DEVICE} SELECT * FROM snap",
    "param_history": f"WITH {NAMED}, {SNAP} {history('previous_row')}",
    "param_history_locf": f"WITH {NAMED}, {SNAP} {history('locf')}",
    "param_history_by_device": f"""WITH {NAMED}, {SNAP_DEVICE}
        {history('previous_row', 'PARTITION BY device_id', 'device_id,')}""",
    "period_stat": f"WITH {METER}, {SNAP_METER}, history AS ({history('previous_row')}) {period_stat(False)}",
    "period_report": f"""WITH {NAMED}, {SNAP}, filled AS ({history('previous_row')}),
        history AS (SELECT * FROM filled WHERE time BETWEEN '{START}' AND '{FINISH}') {period_stat(True)}""",
    "history_by_device": f"""WITH {NAMED}, {SNAP_DEVICE}, filled AS (
            {history('previous_row', 'PARTITION BY device_id', 'device_id,')})
        SELECT * FROM filled WHERE time BETWEEN '{START}' AND '{FINISH}'""",
    "period_report_by_device": f"""WITH {NAMED}, {SNAP_DEVICE}, filled AS (
            {history('previous_row', 'PARTITION BY device_id', 'device_id,')}),
        history AS (SELECT * FROM filled WHERE time BETWEEN '{START}' AND '{FINISH}')
        {period_stat(True).replace('SELECT ', 'SELECT device_id, ', 1)} GROUP BY device_id""",
    "bucket_stats_1d": f"WITH {METER} {bucket_stats('meter', 'day')}",
    "bucket_stats_1h": f"WITH {NAMED} {bucket_stats('gauges', 'hour', True)}",
    "decode_frames": f"""WITH {FRAMES}, {READ} SELECT frame_id, device_id, ts, address, name, type,
        TRY_CAST(whole AS BIGINT) AS raw_value, value FROM readings""",
    "decode_with_context": f"""WITH {FRAMES}, {READ}, chosen AS (SELECT * FROM scaled
            WHERE register_no IN (0, 4, 5, 6)),
        other AS (SELECT w[1] AS unused, frame_id FROM frames)
        SELECT frame_id, device_id, ts, address, name,
        CASE WHEN preprocessing THEN round(scaled / (abs(0.25::DOUBLE * second_word) + 1), 8)
            ELSE scaled END AS value
        FROM (SELECT c.*, CASE WHEN s >= 32768 THEN s - 65536 ELSE s END AS second_word FROM (
            SELECT *, (((frame_id - register_line) // 8) * 7919) % 65536 AS s FROM (
                SELECT *, frame_id % 8 AS register_line FROM chosen)) c)""",
    "decode_with_memory": f"""WITH {FRAMES.replace("l_orderkey * 8 + l_linenumber AS", "(l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS")},
        {READ}, seen AS (SELECT frame_id, device_id, ts, last_value(CASE WHEN frame_id % 3 <> 0 THEN
                CASE WHEN w[2] >= 32768 THEN w[2] - 65536 ELSE w[2] END END IGNORE NULLS) OVER (
                PARTITION BY device_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS second_word FROM frames)
        SELECT c.frame_id, c.device_id, c.ts, address, name,
            CASE WHEN preprocessing THEN round(scaled / (abs(0.25::DOUBLE * second_word) + 1), 8) ELSE scaled END AS value
        FROM scaled c JOIN seen s ON s.frame_id = c.frame_id AND s.device_id = c.device_id AND s.ts = c.ts
        WHERE register_no = 6 OR (register_no IN (0, 4, 5) AND c.frame_id % 3 <> 0)""",
    "overhanging_registers": f"""WITH {FRAMES} SELECT frame_id, device_id, ts, address, name
        FROM frames, registers WHERE enabled AND address BETWEEN 500 AND 505 AND NOT ({FITS})""",
    "precision_first": f"""SELECT l_orderkey, l_linenumber, l_extendedprice,
        round({precision("l_extendedprice")}, 10) AS v, round({precision("l_discount")}, 10) AS w FROM lineitem""",
    "adjusted_address": f"""WITH {PART_REGISTERS} SELECT device_id, register_no, address,
        CASE WHEN is_zero THEN address ELSE greatest(address - 1, 0) END AS wire_address
        FROM registers r JOIN devices d ON d.id = r.device_id""",
    "ingest_frames": f"{INGEST} SELECT * FROM stored",
    "stream_ingest": f"{INGEST} {FIRST_OF_KEY}",
    "ingest_two_starts": f"{INGEST_WEEKS} {FIRST_OF_KEY}",
    "range_overlaps": f"""WITH {PART_RANGES}, r AS (SELECT *, start + "count" AS stop FROM ranges)
        SELECT device_id, range_no, start, stop FROM r WHERE EXISTS (SELECT 1 FROM r o
            WHERE o.device_id = r.device_id AND o.range_no <> r.range_no
            AND NOT (o.stop <= r.start OR r.stop <= o.start))""",
    "registers_in_ranges": f"""WITH {PART_REGISTERS}, {PART_RANGES}
        SELECT r.device_id, r.register_no, r.address, g.range_no, g.start, g."count"
        FROM registers r JOIN ranges g ON r.device_id = g.device_id AND r.reg_type = 'holding'
        AND r.address >= g.start AND r.address < g.start + g."count" """,
    "enabled_registers": f"""WITH {PART_REGISTERS} SELECT r.* FROM registers r JOIN devices d ON d.id = r.device_id
        WHERE r.enabled AND (d.enabled OR d.id IN (0, 5))""",
    "plan_frames": f"WITH RECURSIVE {WIRED} SELECT * FROM planned",
    "frame_sizes": f"""WITH RECURSIVE {WIRED} SELECT device_id, reg_type, frame_no, frame_start,
        max(wire_address + words) - frame_start AS total_words, count(*) AS n_registers
        FROM planned GROUP BY device_id, reg_type, frame_no, frame_start""",
    "resolve_addresses": f"""WITH {RESOLVE} SELECT device_id, spec_no, pos, address, register_no, name
        FROM asked JOIN defined USING (device_id, address)""",
    "parse_catalog": f"""WITH {CONFIGS} SELECT device_id, register_no, ((k * 37) % 500)::INT AS address,
        p_name AS name, 'uint16' AS type, CASE WHEN k % 3 = 0 THEN 'input' ELSE 'holding' END AS reg_type,
        CASE WHEN k % 4 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS scale, k % 5 = 0 AS preprocessing,
        k % 7 <> 0 AS enabled FROM r JOIN part ON p_partkey = k
        WHERE k % 13 <> 0 AND k % 17 <> 0 AND device_id % 10 <> 0""",
    "catalog_rejects": f"""WITH {CONFIGS}
        SELECT device_id::VARCHAR AS source, 'register' AS kind, device_id, register_no AS number,
            CASE WHEN k % 13 = 0 THEN 'register without a valid ''address''' WHEN k % 17 = 0
                THEN 'invalid register type' ELSE 'register of a rejected device' END
            AS reason FROM r WHERE k % 13 = 0 OR k % 17 = 0 OR device_id % 10 = 0
        UNION ALL SELECT id::VARCHAR, 'device', id, NULL, 'invalid parity' FROM d WHERE id % 10 = 0
        UNION ALL SELECT id::VARCHAR, 'range', id, 0, CASE WHEN id % 6 = 0 THEN 'invalid period'
            ELSE 'range of a rejected device' END FROM d WHERE id % 6 = 0 OR id % 10 = 0""",
    "column_types": f"""WITH {PART_REGISTERS} SELECT device_id, register_no, type, scale,
        CASE WHEN type = 'float32' THEN 'FLOAT'
            WHEN scale = 1 THEN CASE type WHEN 'uint32' THEN 'BIGINT' WHEN 'uint64' THEN 'DECIMAL(20,0)'
                ELSE 'INTEGER' END
            WHEN type IN ('int16', 'uint16') THEN 'DECIMAL(6,2)'
            WHEN type IN ('int32', 'uint32') THEN 'DECIMAL(10,2)' ELSE 'DECIMAL(20,2)' END AS column_type
        FROM registers WHERE enabled""",
    "period_seconds": """WITH p AS (SELECT l_quantity::INT AS q, substr('smhdx', (l_orderkey % 5 + 1)::INT, 1) AS u
            FROM lineitem),
        s AS (SELECT q || u AS period, count(*) AS n,
            any_value(q * CASE u WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END) AS seconds
            FROM p GROUP BY 1)
        SELECT period, n, CASE WHEN seconds BETWEEN 5 AND 86400 THEN seconds END AS seconds FROM s""",
    "deadband_heartbeat": deadband(STEPS, 1e-9, "INTERVAL 15 HOURS"),
    "deadband_wide": deadband(GAUGES, 25.0, "INTERVAL 15 HOURS"),
    "change_filter": f"""WITH {STEPS}, m AS (SELECT *, lag(value) OVER (PARTITION BY device_id, register_name
            ORDER BY "timestamp") AS previous FROM gauges)
        SELECT id, device_id, "timestamp", register_name, value FROM m
        WHERE previous IS NULL OR value <> previous""",
    "wide_import": f"WITH {IMPORTED} SELECT * FROM imported",
    "unpivot_clean": f"WITH {EXPORTS} SELECT * FROM long",
    "export_files": f"""WITH {EXPORTS} SELECT file, "Time", register_name, value FROM long""",
    "workbooks": """WITH kept AS (SELECT (l_orderkey // 20000)::VARCHAR AS book,
            l_shipdate + to_seconds((l_orderkey * 7919) % 86400) AS "timestamp", l_quantity AS q, l_discount AS d, l_tax AS t
            FROM lineitem WHERE l_quantity > 2)
        SELECT book, "timestamp", 'quantity(n)' AS register_name, q AS value FROM kept
        UNION ALL SELECT book, "timestamp", 'discount(%)', d FROM kept
        UNION ALL SELECT book, "timestamp", 'tax(C)', t FROM kept
        UNION ALL SELECT book, "timestamp", 'flag(NA)', NULL FROM kept""",
    "missing_columns": "SELECT DISTINCT l_suppkey::VARCHAR AS file, 'pf(NA)' AS register_name FROM lineitem",
    "constant_registers": f"""WITH {EXPORTS.replace("l_suppkey", "l_orderkey")}
        SELECT file, register_name, min("Time") AS "Time"
        FROM long WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) = 1""",
    "staging_replaced": f"""WITH {IMPORTED.replace("FROM lineitem)", "FROM lineitem WHERE ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) % 2 = 0)")}
        SELECT device_id, "timestamp", register_name, value FROM imported""",
    "schema_drift": DRIFT,
    "wide_schema": f"SELECT {LINE_KEYS}, {WIDE_TYPED}, l_discount AS off FROM lineitem",
    "wide_rejects": WIDE_REJECTS,
    "staging_count": f"WITH {IMPORTED} SELECT count(*) AS n_rows FROM imported",
    "append_dedup": f"""WITH {GAUGES} SELECT min(id) AS id, device_id,
        date_trunc('millisecond', "timestamp") AS "timestamp", register_name, arg_min(value, id) AS value
        FROM gauges GROUP BY 2, 3, 4""",
    "refresh_aggregate": f"""WITH {COUNTERS}, stats AS ({tariff_stats('gauges', EVENT_TYPES)})
        SELECT * FROM stats WHERE register_name <> 'error' OR ({WINDOWED})""",
    "refresh_lost_day": f"""WITH {COUNTERS}, stats AS ({tariff_stats('gauges', EVENT_TYPES)})
        SELECT * FROM stats WHERE day NOT IN (TIMESTAMP '2024-01-14', TIMESTAMP '2024-01-15')""",
    "refresh_bucket_stats": f"""WITH {NAMED}, stats AS ({bucket_stats('gauges', 'day', True)})
        SELECT * FROM stats""",
    "refresh_touched": f"""WITH {NAMED}, stored AS (SELECT DISTINCT ON (device_id, "timestamp", register_name) * FROM (
        SELECT id, device_id, date_trunc('millisecond', "timestamp") AS "timestamp", register_name, value FROM gauges)
        ORDER BY device_id, "timestamp", register_name,
            (id % 7 = 0 AND "timestamp" < TIMESTAMP '2024-01-04'), id) {bucket_stats('stored', 'day', True)}""",
    "stream_bucket_stats": f"WITH {NAMED} {bucket_stats('gauges', 'day', True)}",
    "refresh_snapshot": f"WITH {NAMED}, {SNAP} SELECT * FROM snap",
    "stream_snapshot_7m": stream_snapshot("7 MINUTES"),
    "stream_snapshot_1h": stream_snapshot("1 HOUR"),
    "decode_default_rule": f"""WITH {FRAMES}, raw AS (
            SELECT frame_id, device_id, ts, w[5] * 2253 + 4 AS v FROM frames)
        SELECT frame_id, device_id, ts, 'digit' AS name, CASE WHEN device_id = 1
            THEN round({precision("v::DOUBLE")}, 10) ELSE v::DOUBLE END AS value FROM raw""",
    "stream_snapshot_1m": f"""WITH {GAUGES}, m AS (SELECT {MINUTE} AS minutets, register_name,
            arg_max_null(value, {BY_TIME_AND_DEVICE}) AS value FROM gauges GROUP BY 1, 2)
        SELECT * FROM m WHERE minutets + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)""",
    "stream_deadband": deadband(STEPS, 1e-9, "INTERVAL 15 HOURS"),
    "stream_decode": f"""WITH {FRAMES}, {READ} SELECT device_id, ts AS "timestamp", name AS register_name, value
        FROM readings""",
    "stream_dedup": f"""WITH {GAUGES} SELECT min(id) AS id, device_id,
        date_trunc('millisecond', "timestamp") AS "timestamp", register_name, arg_min(value, id) AS value
        FROM gauges GROUP BY 2, 3, 4""",
    "stream_tariff_stats": f"WITH {COUNTERS} {tariff_stats('gauges', EVENT_TYPES)}",
}
