"""Minute snapshots, their gap-filled history, and statistics of a period."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.catalog import MINUTE_REGISTERS, PERIOD_RULES, parse_rules
from wattline.functions.naming import column_name
from wattline.functions.time import (
    as_timestamp, bucket, bucket_offset, in_range, shift, utc_date, width_micros, width_months,
)
from wattline.operators.ordered import fill_gaps

WARM_UP = "24 hours"

def by_time_and_device():
    """Order of readings by time, then device, as one number of 32 digits, whatever the bucket.

    A fixed-width ordering keeps ``max_by`` in hash aggregation, where a struct would need a sort.
    """
    micros = F.unix_micros("timestamp").cast("decimal(20,0)")
    return micros * F.lit(2**32).cast("decimal(10,0)") + F.col("device_id").cast("decimal(10,0)")


def by_place_in_bucket(width):
    """The same order for readings of one bucket, as a long where the bucket is below 2^31 microseconds: it takes
    a third of the memory."""
    if width_months(width) or width_micros(width) >= 2**31:
        return by_time_and_device()
    place = F.pmod(F.unix_micros("timestamp") - F.lit(bucket_offset(width)), F.lit(width_micros(width)))
    return place * F.lit(2**32) + F.col("device_id").cast("long")


def wanted_register(registers, case_insensitive=False):
    """The register under the spelling of the list, NULL if it is not listed."""
    if not case_insensitive:
        return F.when(F.col("register_name").isin(registers), F.col("register_name"))
    spelling = F.create_map(*[F.lit(x) for r in registers for x in (r.lower(), r)])
    return spelling[F.lower("register_name")]


def snapshot(
    telemetry, width="1 minute", registers=MINUTE_REGISTERS, by_device=False,
    case_insensitive=False, time="minutets",
):
    """Last value of each register in each bucket, one column per register.

    A bucket appears if it has any row, also of an unlisted register. The key is the bucket
    alone unless ``by_device``.
    """
    registers = list(registers)
    rows = telemetry.select(
        bucket(F.col("timestamp"), width).alias(time),
        "device_id",
        wanted_register(registers, case_insensitive).alias("register_name"),
        "timestamp",
        "value",
    )
    keys = [time, "device_id"] if by_device else [time]
    order = F.col("timestamp") if by_device else by_time_and_device()
    wide = rows.groupBy(*keys).pivot("register_name", registers).agg(F.max_by("value", order))
    return wide.select(*keys, *[F.col(f"`{r}`").alias(column_name(r)) for r in registers])


def snapshot_long(telemetry, width="1 minute", time="minutets"):
    """Last value per bucket and register, in long form."""
    at = bucket(F.col("timestamp"), width).alias(time)
    return telemetry.groupBy(at, "register_name").agg(F.max_by("value", by_time_and_device()).alias("value"))


def param_history(
    snapshots, start, end=None, fill="previous_row", by_device=False, decimal=False,
    warm_up=WARM_UP, time="minutets", newest_first=True,
):
    """Snapshots of ``[start, end]`` with empty cells filled, newest first unless told otherwise.

    ``previous_row`` looks exactly one row back, as SQL's ``last_value`` does; ``locf`` carries
    the last value forward. The warm-up supplies what comes before ``start``.
    """
    low, high = as_timestamp(start), as_timestamp(end)
    keys = ["device_id"] if by_device else []
    cols = [c for c in snapshots.columns if c not in ("device_id", "date", time)]
    rows = snapshots.filter(in_range(snapshots, shift(low, warm_up), high, ts=time))
    rows = rows.select(F.col(time).alias("time"), *keys, *cols)
    rows = rows.withColumn("day", utc_date(F.col("time")))
    filled = fill_gaps(rows, keys, "day", ["time"], cols, fill)
    values = [F.col(c).cast("decimal(38,10)").alias(c) for c in cols] if decimal else cols
    history = filled.filter(F.col("time").between(low, high)).select("time", *keys, *values)
    return history.orderBy(F.desc("time"), *keys) if newest_first else history


def statistic(stat, value):
    """Aggregate for a rule such as ``min>=100``, ``avg`` or ``range``."""
    kind, _, limit = stat.partition(">")
    if limit:
        at_least = limit.startswith("=")
        bound = F.lit(float(limit.lstrip("=")))
        value = F.when(value >= bound if at_least else value > bound, value)
    if kind == "range":
        return F.max(value) - F.min(value)
    return {"min": F.min, "max": F.max, "avg": F.avg, "count": F.count}[kind](value)


def period_stat(history, keys=(), decimal=False):
    """One row of statistics over a filled history (one per device with ``keys``)."""
    rules = [(source.lower(), stat, column) for source, stat, column in parse_rules(PERIOD_RULES)]
    have = set(history.columns)
    aggregates = [
        (statistic(stat, F.col(source)) if source in have else F.lit(None).cast("double"))
        for source, stat, _ in rules
    ]
    named = [
        (a.cast("decimal(38,10)") if decimal else a).alias(column)
        for a, (_, _, column) in zip(aggregates, rules)
    ]
    return history.groupBy(*keys).agg(*named) if keys else history.agg(*named)


def filled_long(telemetry, start, end=None, by_device=False, width="1 minute", registers=MINUTE_REGISTERS,
                case_insensitive=False, warm_up=WARM_UP):
    """(cells, present): the history of ``[start, end]`` filled by the preceding row, in long form.

    A reading counts in its own bucket and, where its register has none there, in the next bucket that is
    present; so rows hold one value each, however many registers there are. ``present`` are the buckets of
    the range with any row. Rows are put in order twice, by day and by register and day, as one row for each
    bucket and register. Each order has a stage of its own, which holds rows once and no table of groups.
    """
    low, high = as_timestamp(start), as_timestamp(end)
    keys = ["device_id"] if by_device else []
    rows = telemetry.select(
        bucket(F.col("timestamp"), width).alias("time"), "device_id",
        wanted_register(list(registers), case_insensitive).alias("register_name"), "timestamp", "value",
    )
    rows = rows.filter(in_range(rows, shift(low, warm_up), high, ts="time"))
    order = F.col("timestamp") if by_device else by_place_in_bucket(width)
    # Rows without a listed register say that their bucket is there.
    cells = rows.groupBy(*keys, "time", "register_name").agg(F.max_by("value", order).alias("value"))
    cells = cells.withColumn("day", utc_date(F.col("time")))
    # The next bucket: inside a day by a window, at its end the first bucket of the next day that has one.
    heads = rows.groupBy(*keys, utc_date(F.col("time")).alias("day")).agg(F.min("time").alias("head"))
    heads = heads.select(*keys, "day", F.lead("head").over(Window.partitionBy(*keys).orderBy("day")).alias("head"))
    later = Window.partitionBy(*keys, "day").orderBy(F.unix_micros("time").desc()).rangeBetween(Window.unboundedPreceding, -1)
    known = cells.withColumn("after", F.min("time").over(later)).join(heads, [*keys, "day"])
    known = known.filter("register_name IS NOT NULL AND value IS NOT NULL").select(
        *keys, "register_name", "time", "value", F.coalesce("after", "head").alias("after"))
    # Readings of a day's last bucket go to the next day too, ahead of its own.
    own, next_day = utc_date(F.col("time")), utc_date(F.col("after"))
    days = F.when(next_day != own, F.array(own, next_day)).otherwise(F.array(own))
    known = known.withColumn("day", F.explode(days))
    follows = F.lead("time").over(Window.partitionBy(*keys, "register_name", "day").orderBy("time"))
    known = known.withColumn("follows", follows)
    twice = F.array(
        F.struct(F.col("time"), (F.col("day") == own).alias("counts")),
        F.struct(F.col("after").alias("time"), ((F.col("day") == next_day) & ~F.col("after").eqNullSafe(F.col("follows"))).alias("counts")))
    counted = known.select(*keys, "register_name", "value", F.inline(twice)).filter("counts")
    within = F.col("time").between(low, high)
    filled = counted.filter(within).select(*keys, "time", "register_name", "value")
    return filled, rows.filter(within).select(*keys, "time").distinct()


def period_stat_long(cells, present, keys=(), registers=MINUTE_REGISTERS):
    """``period_stat`` of a filled history in long form: each statistic once for each register, then the
    rules pick theirs. A device whose registers have no values has a row too."""
    keys = list(keys)
    rules = [(source.lower(), stat, column) for source, stat, column in parse_rules(PERIOD_RULES)]
    column_of = {column_name(r): r for r in registers}
    kinds = {stat: f"s{i}" for i, stat in enumerate(dict.fromkeys(stat for _, stat, _ in rules))}
    each = cells.groupBy(*keys, "register_name").agg(
        *[statistic(stat, F.col("value")).alias(name) for stat, name in kinds.items()])

    def pick(source, stat):
        if source not in column_of:
            return F.lit(None).cast("double")
        found = F.max(F.when(F.col("register_name") == column_of[source], F.col(kinds[stat])))
        return F.coalesce(found, F.lit(0)) if stat == "count" else found

    named = [pick(source, stat).alias(column) for source, stat, column in rules]
    if not keys:
        return each.agg(*named)
    return present.select(*keys).distinct().join(each, keys, "left").groupBy(*keys).agg(*named)
