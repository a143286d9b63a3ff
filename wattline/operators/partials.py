"""Bucket statistics as partial states that merge: what streams keep, and what late rows are added to."""

from pyspark.sql import functions as F

from wattline.catalog import DAY_RULES, parse_rules
from wattline.functions.time import bucket
from wattline.operators.stats import plain_statistics, spread

# Parts of which a statistic is made.
_PARTS = {"min": ("min",), "max": ("max",), "range": ("min", "max"), "avg": ("sum", "count"), "count": ("count",)}
_MERGE = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}


def _rules(rules):
    return parse_rules(rules) if isinstance(rules, str) else list(rules)


def _parts(rules):
    """{column: (part, value limit)} of all statistics of the rules; parts that agree are kept once."""
    out = {}
    for stat in plain_statistics(rules):
        kind, _, limit = stat.partition(">")
        for part in _PARTS[kind]:
            out[f"{part}_{limit.replace('=', 'from_').replace('.', '_')}"] = (part, limit)
    return out


def _above(limit):
    value = F.col("value")
    if not limit:
        return value
    bound = F.lit(float(limit.lstrip("=")))
    return F.when(value >= bound if limit.startswith("=") else value > bound, value)


def partial_stats(telemetry, width="1 day", rules=DAY_RULES, time="metricts"):
    """(time, device_id, register_name, first and last reading, sums and counts ...): one state per bucket,
    device and register; registers without a rule share a state, as they only show that there is a row."""
    rules = _rules(rules)
    registers = list(dict.fromkeys(source for source, _, _ in rules))
    listed = F.when(F.col("register_name").isin(registers), F.col("register_name"))
    rows = telemetry.select(
        bucket(F.col("timestamp"), width).alias(time), "device_id", listed.alias("register_name"), "timestamp", "value")
    make = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    return rows.groupBy(time, "device_id", "register_name").agg(
        F.min("timestamp").alias("first_t"), F.min_by("value", "timestamp").alias("first_v"),
        F.max("timestamp").alias("last_t"), F.max_by("value", "timestamp").alias("last_v"),
        *[make[part](_above(limit)).alias(name) for name, (part, limit) in _parts(rules).items()])


def merged_partials(partials, rules=DAY_RULES, time="metricts"):
    """One state per bucket, device and register, of any number of them; the order does not matter."""
    return partials.groupBy(time, "device_id", "register_name").agg(
        F.min("first_t").alias("first_t"), F.min_by("first_v", "first_t").alias("first_v"),
        F.max("last_t").alias("last_t"), F.max_by("last_v", "last_t").alias("last_v"),
        *[_MERGE[part](name).alias(name) for name, (part, _) in _parts(_rules(rules)).items()])


def finished_stats(partials, rules=DAY_RULES, time="metricts"):
    """The statistics of merged states, in the form of ``bucket_stats``."""
    rules = _rules(rules)

    def value(stat):
        kind, _, limit = stat.partition(">")
        part = {p: F.col(f"{p}_{limit.replace('=', 'from_').replace('.', '_')}") for p in _PARTS[kind]}
        if kind == "range":
            return part["max"] - part["min"]
        if kind == "avg":
            return F.when(part["count"] > 0, part["sum"] / part["count"])
        return part[kind]

    reduced = partials.select(
        time, "device_id", "register_name",
        *[value(stat).alias(f"s{i}") for i, stat in enumerate(plain_statistics(rules))],
        (F.col("last_v") - F.col("first_v")).alias("delta"), F.col("last_v").alias("end"))
    return spread(reduced, rules, time)
