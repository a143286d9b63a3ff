"""Newest value at an instant, and the change between two instants."""

from pyspark.sql import functions as F

from wattline.functions.naming import display_name
from wattline.functions.time import as_timestamp, in_range, shift

LOOKBACK = "4 hours"


def field_frame(spark, fields):
    """The requested registers with their place in the list, one row per list entry."""
    names = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
    places = spark.range(1).select(F.posexplode(names).alias("pos", "register_name"))
    return places.select("register_name", (F.col("pos") + 1).alias("nr"))


def named_fields(spark, fields, directory=None, friendly_name=False, add_unit=False):
    """The requested registers with place and display name."""
    places = field_frame(spark, fields)
    if directory is None or not friendly_name:
        return places.withColumn("metric", F.col("register_name"))
    names = directory.select("register_name", "ua_friendly_name", "unit")
    return places.join(names, "register_name", "left").select(
        "register_name",
        "nr",
        display_name(
            F.col("register_name"), F.col("ua_friendly_name"), F.col("unit"), friendly_name, add_unit
        ).alias("metric"),
    )


def latest(df, keys=("register_name",)):
    """Newest value per key, also if it is NULL; at equal times the higher device wins.

    Grouping by device first keeps the ordering a plain timestamp, which Spark aggregates by
    hash on the map side. The second step sees one row per key and device.
    """
    per_device = df.groupBy(*keys, "device_id").agg(
        F.max("timestamp").alias("timestamp"), F.max_by("value", "timestamp").alias("value")
    )
    return per_device.groupBy(*keys).agg(
        F.max("timestamp").alias("timestamp"),
        F.max_by("value", F.struct("timestamp", "device_id")).alias("value"),
    )


def last_known(telemetry, device_id=None):
    """Newest value per register over all time, of one device or of each; NULL values left out."""
    if device_id is not None:
        telemetry = telemetry.filter(F.col("device_id") == device_id)
    newest = telemetry.groupBy("device_id", "register_name").agg(
        F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("timestamp")
    )
    return newest.filter(F.col("value").isNotNull())


def newest_before(telemetry, start, lookback=LOOKBACK):
    """Newest value per register strictly before ``start``, within the lookback."""
    low = shift(start, lookback)
    return latest(telemetry.filter(in_range(telemetry, low, start, high_open=True)))


def last_value_at(
    telemetry, ts, fields, directory=None, friendly_name=False, sort=True, add_unit=False,
    lookback=LOOKBACK,
):
    """One row per requested register: its newest value at ``ts``, or NULL beyond the lookback."""
    at = as_timestamp(ts)
    recent = telemetry.filter(
        in_range(telemetry, shift(at, lookback), at) & F.col("register_name").isin(list(fields))
    )
    names = named_fields(telemetry.sparkSession, fields, directory, friendly_name, add_unit)
    found = names.join(latest(recent).select("register_name", "value"), "register_name", "left")
    order = ["nr", "register_name"] if sort else ["register_name"]
    return found.orderBy(*order).select(at.alias("metricts"), "metric", "value")


def period_diff(
    telemetry, start, finish, fields, directory=None, friendly_name=False, sort=True,
    add_unit=False, lookback=LOOKBACK,
):
    """Newest value at ``finish`` less newest value at ``start``; a missing one counts as 0.

    Both lookbacks are read in one scan; the orderings are NULL outside their own lookback, and
    ``max_by`` passes over rows without ordering.
    """
    begin, end = as_timestamp(start), as_timestamp(finish)
    at_start = in_range(telemetry, shift(begin, lookback), begin)
    at_finish = in_range(telemetry, shift(end, lookback), end)
    rows = telemetry.filter((at_start | at_finish) & F.col("register_name").isin(list(fields)))
    t_start = F.when(at_start, F.col("timestamp"))
    t_finish = F.when(at_finish, F.col("timestamp"))
    per_device = rows.groupBy("register_name", "device_id").agg(
        F.max(t_start).alias("ts"), F.max_by("value", t_start).alias("vs"),
        F.max(t_finish).alias("tf"), F.max_by("value", t_finish).alias("vf"),
    )

    def across_devices(value, ts):
        return F.max_by(value, F.when(F.col(ts).isNotNull(), F.struct(ts, "device_id")))

    ends = per_device.groupBy("register_name").agg(
        across_devices("vs", "ts").alias("vs"), across_devices("vf", "tf").alias("vf")
    )
    names = named_fields(telemetry.sparkSession, fields, directory, friendly_name, add_unit)
    zero = F.lit(0.0)
    order = ["nr", "register_name"] if sort else ["register_name"]
    return (
        names.join(ends, "register_name", "left")
        .orderBy(*order)
        .select(
            end.alias("metricts"),
            "metric",
            (F.coalesce("vf", zero) - F.coalesce("vs", zero)).alias("value"),
        )
    )
