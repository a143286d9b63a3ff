"""Statistics per bucket and device, and per tariff zone."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.catalog import DAY_RULES, TARIFF_REGISTERS, parse_rules
from wattline.functions.tariff import tariff_zone
from wattline.functions.time import DAY_MICROS, bucket, utc_date
from wattline.operators.snapshot import statistic


def bucket_stats(telemetry, width="1 day", rules=DAY_RULES, time="metricts"):
    """One row per bucket and device with the statistics of the rules as columns.

    Rows are first reduced per (bucket, device, register) and only then spread into columns.
    A (bucket, device) appears if it has any row; counts are then 0, everything else NULL.
    """
    rules = parse_rules(rules) if isinstance(rules, str) else list(rules)
    registers = list(dict.fromkeys(source for source, _, _ in rules))
    aggregates = {f"s{i}": statistic(stat, F.col("value")) for i, stat in enumerate(plain_statistics(rules))}
    if any(s in ("delta", "end") for _, s, _ in rules):
        last = F.max_by("value", "timestamp")
        aggregates["delta"] = last - F.min_by("value", "timestamp")
        aggregates["end"] = last
    rows = telemetry.select(
        bucket(F.col("timestamp"), width).alias(time),
        "device_id",
        F.when(F.col("register_name").isin(registers), F.col("register_name")).alias("register_name"),
        "timestamp",
        "value",
    )
    reduced = rows.groupBy(time, "device_id", "register_name").agg(
        *[a.alias(name) for name, a in aggregates.items()]
    )
    return spread(reduced, rules, time)


def plain_statistics(rules):
    """The statistics of rules that are one aggregate each, in their order."""
    return list(dict.fromkeys(s for _, s, _ in rules if s not in ("delta", "end")))


def spread(reduced, rules, time="metricts"):
    """Statistics per (bucket, device, register), in columns s0, s1, ..., delta and end, as one row per
    (bucket, device) with a column for each rule."""
    registers = list(dict.fromkeys(source for source, _, _ in rules))
    names = [c for c in reduced.columns if c not in (time, "device_id", "register_name")]
    slot = {stat: f"s{i}" for i, stat in enumerate(plain_statistics(rules))}
    wide = reduced.groupBy(time, "device_id").pivot("register_name", registers).agg(
        *[F.first(name).alias(name) for name in names]
    )

    def cell(source, stat):
        name = source if len(names) == 1 else f"{source}_{slot.get(stat, stat)}"
        value = F.col(f"`{name}`")
        return F.coalesce(value, F.lit(0)) if stat == "count" else value

    return wide.select(
        time, "device_id", *[cell(source, stat).alias(column) for source, stat, column in rules]
    )


def tariff_stats(telemetry, registers=TARIFF_REGISTERS, width="1 day", tz="UTC", **zone):
    """Per (day, device, register, zone): last less first, last, highest and lowest value.

    The night of a calendar day is two pieces, before 07:00 and from 23:00; the difference runs
    over both, from the first row of the one to the last row of the other.
    """
    last = F.max_by("value", "timestamp")
    return (
        telemetry.filter(F.col("register_name").isin(list(registers)))
        .groupBy(
            bucket(F.col("timestamp"), width).alias("day"),
            "device_id",
            "register_name",
            tariff_zone(F.col("timestamp"), tz, **zone).alias("zone"),
        )
        .agg(
            (last - F.min_by("value", "timestamp")).alias("diff_value"),
            last.alias("end_value"),
            F.max("value").alias("max_value"),
            F.min("value").alias("min_value"),
        )
    )


def price_at(prices, ts):
    """The newest price row not after ``ts``: no row or one."""
    return (
        prices.filter(F.col("dt") <= ts)
        .orderBy(F.desc("dt"))
        .limit(1)
        .select(F.col("dprice").alias("d_price"), F.col("nprice").alias("n_price"))
    )


def daily_prices(prices):
    """The price of each calendar day from the first change to the last.

    Prices are reduced to one row per day before they are put in order, so the ordered pass is
    over days.
    """
    # A price from later than midnight first counts on the following day.
    since = utc_date(F.timestamp_micros(F.unix_micros("dt") + F.lit(DAY_MICROS - 1)))
    changes = prices.groupBy(since.alias("since")).agg(
        F.max_by("dprice", "dt").alias("d_price"), F.max_by("nprice", "dt").alias("n_price")
    )
    following = F.lead("since").over(Window.orderBy("since"))
    until = F.coalesce(F.date_sub(following, 1), F.col("since"))
    return changes.withColumn("until", until).select(
        F.explode(F.sequence("since", "until")).alias("price_day"), "d_price", "n_price"
    )


def with_price(df, prices, day="day"):
    """Adds to each row the newest price not after the midnight of its day (or NULLs).

    Days behind the last change take the price of its day, so the join is on equal days.
    """
    daily = daily_prices(prices)
    last_day = daily.agg(F.max("price_day")).scalar()
    dated = df.withColumn("price_day", F.least(F.col(day), last_day))
    return dated.join(daily, "price_day", "left").drop("price_day")


def tariff_report(stats, prices, total="max"):
    """Per (date, device, register): use by zone, its cost at the day's price, and the total.

    The total is the larger of the zones, not their sum, as the night's piece spans the day;
    ``total="sum"`` gives the older form.
    """
    by_day = stats.groupBy(utc_date(F.col("day")).alias("day"), "device_id", "register_name").agg(
        F.max(F.when(F.col("zone") == "day", F.col("diff_value"))).alias("day_diff"),
        F.max(F.when(F.col("zone") == "night", F.col("diff_value"))).alias("night_diff"),
        {"max": F.max, "sum": F.sum}[total]("diff_value").alias("total_diff"),
    )
    priced = with_price(by_day, prices)
    return priced.select(
        "day",
        "device_id",
        "register_name",
        "day_diff",
        (F.col("day_diff") * F.col("d_price")).alias("day_cost"),
        "night_diff",
        (F.col("night_diff") * F.col("n_price")).alias("night_cost"),
        "total_diff",
    )


def tariff_report_sum(stats):
    """The older report: keyed by the bucket itself, total over both zones, no prices."""
    return stats.groupBy("day", "device_id", "register_name").agg(
        F.max(F.when(F.col("zone") == "day", F.col("diff_value"))).alias("day_diff"),
        F.max(F.when(F.col("zone") == "night", F.col("diff_value"))).alias("night_diff"),
        F.sum("diff_value").alias("total_diff"),
    )
