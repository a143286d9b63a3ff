"""Bucketed series: averages, and gap filling by carrying the last bucket forward."""

from pyspark.sql import functions as F

from wattline.functions.time import (
    as_timestamp, bucket, bucket_micros, in_range, width_micros,
)
from wattline.operators.latest import LOOKBACK, field_frame, named_fields, newest_before
from wattline.operators.ordered import with_previous

#: Buckets of a register that are put in order, or made for a gap, at once.
CHUNK_BUCKETS = 10_000


def period_avg(telemetry, width, keys=("register_name",)):
    """Unweighted average per bucket and register."""
    return telemetry.groupBy(bucket(F.col("timestamp"), width).alias("bucket"), *keys).agg(
        F.avg("value").alias("value")
    )


def _with_next(observed, size):
    """Adds ``next_at``: the start of the following observed bucket of the register."""
    span = F.lit(size * CHUNK_BUCKETS)
    backwards = observed.withColumns({"back": -F.col("at"), "chunk": F.floor(-F.col("at") / span)})
    known = with_previous(backwards, ["register_name"], "chunk", ["back"], ["at"])
    return known.withColumnRenamed("prev_at", "next_at").drop("back", "chunk")


def gap_filled(telemetry, start, finish, width, fields, lookback=LOOKBACK):
    """Every bucket of ``[start, finish)`` per register that has a row in ``[start, finish]``.

    An observed bucket has its average, and is carried over the empty ones behind it; a NULL
    average is carried too. Buckets ahead of the first observation get the newest value from
    before ``start``. A row at exactly ``finish`` still makes a bucket of its own.
    """
    begin, end = as_timestamp(start), as_timestamp(finish)
    size = width_micros(width)
    names = list(dict.fromkeys(fields))
    wanted = telemetry.filter(F.col("register_name").isin(names))
    observed = (
        wanted.filter(in_range(wanted, begin, end))
        .groupBy("register_name", bucket_micros(F.unix_micros("timestamp"), width).alias("at"))
        .agg(F.avg("value").alias("value"))
    )
    grid_first = bucket_micros(F.unix_micros(begin), width)
    grid_last = bucket_micros(F.unix_micros(end) - 1, width)
    # The value from before, or NULL, stands as an observation just ahead of the grid.
    seeds = newest_before(wanted, begin, lookback).select("register_name", "value")
    ahead = field_frame(telemetry.sparkSession, names).join(seeds, "register_name", "left").select(
        "register_name", (grid_first - size).alias("at"), "value"
    )
    followed = _with_next(observed.unionByName(ahead), size)
    # It is of use only to a register with observations, the first of them later in the grid.
    useful = (F.col("at") >= grid_first) | (F.col("next_at") > grid_first)
    from_ = F.greatest(F.col("at"), grid_first)
    until = F.coalesce(F.col("next_at") - size, F.greatest(F.col("at"), grid_last))
    # A gap is made in blocks and each block in buckets, so no row holds a long gap.
    block = F.lit(size * CHUNK_BUCKETS)
    blocks = followed.filter(useful).select(
        "register_name", "value", until.alias("until"), F.explode(F.sequence(from_, until, block)).alias("from")
    )
    last = F.least(F.col("until"), F.col("from") + block - F.lit(size))
    slots = blocks.select(
        "register_name", F.explode(F.sequence(F.col("from"), last, F.lit(size))).alias("slot"), "value"
    )
    return slots.select(F.timestamp_micros("slot").alias("bucket"), "register_name", "value")


def period_values(
    telemetry, start, finish, width, fields, directory=None, friendly_name=False, sort=True,
    add_unit=False, lookback=LOOKBACK,
):
    """Gap-filled averages of the requested registers, named and in order of bucket and list."""
    names = named_fields(telemetry.sparkSession, fields, directory, friendly_name, add_unit)
    filled = gap_filled(telemetry, start, finish, width, fields, lookback)
    order = ["bucket", "nr"] if sort else ["bucket"]
    return (
        filled.join(names, "register_name")
        .orderBy(*order)
        .select(F.col("bucket").alias("metricts"), "metric", "value")
    )
