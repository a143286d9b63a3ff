"""The registers and the statistics computed from them.

The register names are the contract with the device; matching is case-sensitive.
"""

from wattline.functions.naming import column_name

# Registers of the minute snapshot, in column order.
MINUTE_REGISTERS = [name.strip() for name in """
aInsidePower(W), aOutsideCurrent(A), aOutsidePower(W), aPower(W), batChargeToday(kWh),
batChargeTotal(kWh), batDischargeToday(kWh), batDischargeTotal(kWh), batteryCurrent(A),
batteryEnergy(%), batteryPower(W), batteryTemp(C), batteryVolt(V), bInsidePower(W),
bOutsideCurrent(A), bOutsidePower(W), bPower(W), cInsidePower(W), cOutsideCurrent(A),
cOutsidePower(W), cPower(W), dailyUsed(kWh), dcTemp(C), FaultCode1(NA), FaultCode2(NA),
FaultCode3(NA), FaultCode4(NA), genAPower(W), genAVolt(V), genBPower(W), genBVolt(V),
genCPower(W), genCVolt(V), genDailyTime(h), genToday(kWh), genTotal(kWh), genTotalPower(W),
gridBuyToday(kWh), gridBuyTotal(kWh), gridFac(Hz), gridInsideTotalPac(W),
gridInsideTotalSac(VA), gridOutsideTotalPac(W), gridOutsideTotalSac(VA), gridSellToday(kWh),
gridSellTotal(kWh), Grid vac1(V), Grid vac2(V), Grid vac3(V), heatsinkTemp(C), iac1(A), iac2(A),
iac3(A), invACurrent(A), invAPower(W), invAVolt(V), invBCurrent(A), invBPower(W), invBVolt(V),
invCCurrent(A), invCPower(W), invCVolt(V), invFac(Hz), invTotalPower(W), invTotalSac(VA),
ipv1(A), ipv2(A), loadAPower(W), loadAVolt(V), loadBPower(W), loadBVolt(V), loadCPower(W),
loadCVolt(V), loadTotalPac(W), loadTotalSac(VA), PF(NA), ppv1(W), ppv2(W), pvEToday(kWh),
pvHistory(kWh), todayPv1(kWh), todayPv2(kWh), todayPv3(kWh), todayPv4(kWh), totalUsed(kWh),
upsLoadAPower(W), upsLoadBPower(W), upsLoadCPower(W), upsLoadTotalPower(W), vpv1(V), vpv2(V)
""".split(",")]

# The counters that tariff statistics are kept for.
TARIFF_REGISTERS = [
    "batChargeTotal(kWh)", "batDischargeTotal(kWh)", "dailyUsed(kWh)", "genTotal(kWh)",
    "gridBuyTotal(kWh)", "gridSellTotal(kWh)", "pvHistory(kWh)", "todayPv1(kWh)",
    "todayPv2(kWh)", "totalUsed(kWh)",
]

# Statistics per bucket and device. ``delta`` is last less first, ``end`` is last.
DAY_RULES = """
aInsidePower(W): min>=100 max avg>=100
aOutsidePower(W): min>=100 max avg>=100
batChargeTotal(kWh): delta end
batDischargeTotal(kWh): delta end
batteryEnergy(%): min max avg
batteryPower(W): min>=100 max avg>=100
batteryTemp(C): min max avg
batteryVolt(V): min>=100 max avg>=100
bInsidePower(W): min>=100 max avg>=100
bOutsidePower(W): min>=100 max avg>=100
cInsidePower(W): min>=100 max avg>=100
dailyUsed(kWh): delta end
dcTemp(C): min max avg
heatSinkTemp(C): min max avg
FaultCode1(NA): count
FaultCode2(NA): count
FaultCode3(NA): count
FaultCode4(NA): count
genAPower(W): min>=100 max avg>=100
genAVolt(V): min>=100 max avg>=100
genBPower(W): min>=100 max avg>=100
genBVolt(V): min>=100 max avg>=100
genCPower(W): min>=100 max avg>=100
genCVolt(V): min>=100 max avg>=100
genTotal(kWh): delta end
genDailyTime(h): delta
genTotalPower(W): min>=100 max avg>=100
gridInsideTotalPac(W): min>=100 max avg>=100
gridOutsideTotalPac(W): min>=100 max avg>=100
gridInsideTotalSac(VA): min>=100 max avg>=100
gridOutsideTotalSac(VA): min>=100 max avg>=100
Grid vac1(V): min>=100 max avg>=100
Grid vac2(V): min>=100 max avg>=100
Grid vac3(V): min>=100 max avg>=100
gridBuyTotal(kWh): delta end
gridSellTotal(kWh): delta end
gridFac(Hz): min max avg
invFac(Hz): min max avg
invAPower(W): min>=100 max avg>=100
invAVolt(V): min>=100 max avg>=100
invBPower(W): min>=100 max avg>=100
invBVolt(V): min>=100 max avg>=100
invCPower(W): min>=100 max avg>=100
invCVolt(V): min>=100 max avg>=100
invTotalPower(W): min>=100 max avg>=100
invTotalSac(VA): min>=100 max avg>=100
loadAPower(W): min>=100 max avg>=100
loadAVolt(V): min>=100 max avg>=100
loadBPower(W): min>=100 max avg>=100
loadBVolt(V): min>=100 max avg>=100
loadCPower(W): min>=100 max avg>=100
loadCVolt(V): min>=100 max avg>=100
ipv1(A): min max
vpv1(V): min>=100 avg>=100
ppv1(W): min>=100 max avg>=100
ipv2(A): min max
vpv2(V): min>=100 avg>=100
ppv2(W): min>=100 max avg>=100
pvHistory(kWh): delta end
todayPv1(kWh): delta end
todayPv2(kWh): delta end
loadTotalPac(W): min>=100 max avg>=100
loadTotalSac(VA): min>=100 max avg>=100
pf(NA): min max avg
totalUsed(kWh): delta end
"""

# Statistics of a period over the minute history. ``range`` is maximum less minimum.
PERIOD_RULES = """
aInsidePower: max
aOutsideCurrent: max
aOutsidePower: max avg
aPower: max avg
batChargeToday: range
batChargeTotal: range min avg
batDischargeToday: min avg
batDischargeTotal: max
batDischargeToday: range
batDischargeTotal: range
batteryCurrent: max
batteryEnergy: max min avg
batteryPower: max avg
batteryTemp: max min avg
batteryVolt: max min avg
bInsidePower: max
bOutsideCurrent: max
bOutsidePower: max avg
bPower: max avg
cInsidePower: max avg
cOutsideCurrent: max
cOutsidePower: max avg
cPower: max avg
dailyUsed: max avg
dcTemp: max avg min
genAPower: max avg
genAVolt: min>100 max
genBPower: avg
genBVolt: min>100 max avg
genCPower: max avg
genCVolt: min>100 max avg
genDailyTime: avg
genToday: max avg
genTotal: range max avg
genTotalPower: max avg
gridBuyToday: range min avg max
gridBuyTotal: range
gridFac: avg min max
gridInsideTotalPac: max avg
gridInsideTotalSac: max avg
gridOutsideTotalPac: max avg
gridOutsideTotalSac: max avg
gridSellToday: range min avg max
gridSellTotal: range
grid_Vac1: max min>100
grid_Vac2: max min>100
grid_Vac3: max min>100
heatSinkTemp: max min avg
iac1: max min avg
iac2: max min avg
iac3: max min avg
invACurrent: max min avg
invAPower: max min avg
invAVolt: max min>100
invBCurrent: max min avg
invBPower: max min avg
invBVolt: max min>100 avg
invCCurrent: max min avg
invCPower: max min avg
invCVolt: max min>100 avg
invFac: max min avg
invTotalPower: max min avg
invTotalSac: max min avg
ipv1: max min avg
ipv2: max min avg
loadAPower: max min avg
loadAVolt: max min>100 avg
loadBPower: max min avg
loadBVolt: max min>100 avg
loadCPower: max min avg
loadCVolt: max min>100 avg
loadTotalPac: max min avg
loadTotalSac: max min avg
pf: max min avg
ppv1: max min>100
ppv2: max min>0
pvEtoday: max min>0
pvHistory: range
todayPv1: max min>0
todayPv2: max min>0
totalUsed: range min avg
vpv1: max min>0 avg
vpv2: max min>0 avg
"""

# First letter of a statistic's column name.
PREFIX = {"min": "n", "max": "x", "avg": "a", "delta": "d", "range": "d", "end": "e", "count": "c"}


def parse_rules(text):
    """Rules as ``(input, statistic, column)``, in text order; the statistic keeps its threshold."""
    rules = []
    for line in text.strip().splitlines():
        source, _, stats = line.rpartition(":")
        for stat in stats.split():
            kind = stat.split(">")[0]
            # Statistics write the grid voltages without the blank that their minute columns keep.
            column = f"{PREFIX[kind]}_{column_name(source)}".replace("_grid_vac", "_gridvac")
            rules.append((source, stat, column))
    return rules
