"""Device configuration in JSON: devices, registers and poll ranges, validated row by row."""

from collections import namedtuple

from pyspark.sql import functions as F

from wattline.functions.decode import SPACES, WORDS
from wattline.functions.time import period_seconds
from wattline.operators.quality import range_overlaps
from wattline.schemas import CONFIG

Catalog = namedtuple("Catalog", "devices registers ranges rejects")


def read_register_catalog(spark, path, strict=False):
    """The catalog from one JSON file or a folder of them."""
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("json")
    )
    return parse_catalog(texts, strict=strict)


def read_address_specs(spark, path):
    """Address specs from text files, one per line; blank lines are left out."""
    lines = spark.read.text(path).select(F.trim("value", F.lit(" \t\r\n")).alias("spec"))
    return lines.filter("spec <> ''")


def parse_catalog(texts, strict=False):
    """The catalog from rows of (source, json).

    Missing optional keys get their defaults. An invalid row goes to ``rejects`` with its reason,
    or with ``strict`` fails the query that reads it.
    """
    config = texts.select("source", F.from_json("json", CONFIG).alias("config"))
    found = config.select(
        "source", F.posexplode_outer("config.devices").alias("device_no", "device")
    )
    devices = found.select(
        "source",
        F.col("device.id").try_cast("int").alias("id"),
        F.coalesce("device.isZero", F.lit(True)).alias("is_zero"),
        F.coalesce("device.enabled", F.lit(True)).alias("enabled"),
        F.struct(
            F.col("device.connection.port").alias("port"),
            F.col("device.connection.baud_rate").try_cast("int").alias("baud_rate"),
            F.upper("device.connection.parity").alias("parity"),
            F.col("device.connection.data_bits").try_cast("int").alias("data_bits"),
            F.col("device.connection.stop_bits").try_cast("int").alias("stop_bits"),
        ).alias("connection"),
        "device",
    )
    link = F.col("connection")
    reason = (
        F.when(F.col("device").isNull(), "missing or invalid 'devices'")
        .when(F.col("id").isNull(), "device without 'id'")
        .when(link["port"].isNull(), "device without 'connection.port'")
        .when(link["baud_rate"].isNull(), "device without 'connection.baud_rate'")
        .when(~F.coalesce(link["parity"].isin("N", "E", "O"), F.lit(False)), "invalid parity")
        .when(link["data_bits"].isNull(), "device without 'connection.data_bits'")
        .when(link["stop_bits"].isNull(), "device without 'connection.stop_bits'")
        .when(F.col("device.registers").isNull(), "device without 'registers'")
    )
    devices = devices.withColumn("reason", reason)
    refused = F.col("reason").isNotNull().alias("refused")
    registers = devices.select(
        "source", F.col("id").alias("device_id"), refused,
        F.posexplode("device.registers").alias("register_no", "r"),
    ).select(
        "source", "device_id", "refused", "register_no",
        F.col("r.address").try_cast("int").alias("address"),
        F.col("r.name").alias("name"),
        F.col("r.type").alias("type"),
        F.coalesce("r.regType", F.lit("holding")).alias("reg_type"),
        F.coalesce("r.scale", F.lit(1.0)).alias("scale"),
        F.coalesce("r.preprocessing", F.lit(False)).alias("preprocessing"),
        F.coalesce("r.enabled", F.lit(True)).alias("enabled"),
    )
    registers = registers.withColumn(
        "reason",
        F.when(F.col("device_id").isNull(), "register of a device without 'id'")
        .when(~_in_address_space("address"), "register without a valid 'address'")
        .when(F.col("name").isNull(), "register without 'name'")
        .when(~F.coalesce(F.col("type").isin(*WORDS), F.lit(False)), "invalid register type")
        .when(~F.col("reg_type").isin(*SPACES), "invalid register space")
        .when(F.col("refused"), "register of a rejected device"),
    ).drop("refused")
    ranges = devices.select(
        "source", F.col("id").alias("device_id"), refused,
        F.posexplode("device.ranges").alias("range_no", "r"),
    ).select(
        "source", "device_id", "refused", "range_no",
        F.col("r.start").try_cast("int").alias("start"),
        F.col("r.count").try_cast("int").alias("count"),
        F.col("r.period").alias("period"),
        period_seconds(F.col("r.period")).alias("period_seconds"),
        F.coalesce("r.regType", F.lit("holding")).alias("reg_type"),
    )
    ranges = ranges.withColumn(
        "reason",
        F.when(F.col("device_id").isNull(), "range of a device without 'id'")
        .when(~_in_address_space("start"), "range without a valid 'start'")
        .when(~F.coalesce(F.col("count") >= 0, F.lit(False)), "range without a valid 'count'")
        .when(F.col("start") + F.col("count") > 65_536, "range beyond the address space")
        .when(F.col("period_seconds").isNull(), "invalid period")
        .when(~F.col("reg_type").isin(*SPACES), "invalid register space")
        .when(F.col("refused"), "range of a rejected device"),
    ).drop("refused")
    in_order = ranges.filter(F.col("reason").isNull())
    clashes = range_overlaps(in_order, ["source", "device_id"]).select(
        "source", "device_id", "range_no", F.lit("overlapping range").alias("clash")
    )
    ranges = ranges.join(clashes, ["source", "device_id", "range_no"], "left")
    ranges = ranges.withColumn("reason", F.coalesce("reason", "clash")).drop("clash")
    devices = devices.drop("device")
    if strict:
        devices, registers, ranges = (_strict(t) for t in (devices, registers, ranges))

    def valid(table):
        return table.filter(F.col("reason").isNull()).drop("reason")

    def rejected(table, kind, device, number):
        return table.filter(F.col("reason").isNotNull()).select(
            "source", F.lit(kind).alias("kind"), F.col(device).alias("device_id"),
            number.alias("number"), "reason",
        )

    rejects = (
        rejected(devices, "device", "id", F.lit(None).cast("int"))
        .unionByName(rejected(registers, "register", "device_id", F.col("register_no")))
        .unionByName(rejected(ranges, "range", "device_id", F.col("range_no")))
    )
    return Catalog(valid(devices), valid(registers), valid(ranges), rejects)


def _in_address_space(column):
    return F.coalesce(F.col(column).between(0, 65_535), F.lit(False))


def _strict(table):
    """The table, failing on a row with a reason."""
    checked = F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("string"))
    return table.withColumn("reason", checked)
