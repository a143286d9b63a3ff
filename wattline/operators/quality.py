"""Checks of catalogs and schemas."""

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from wattline.functions.naming import column_name
from wattline.session import scratch_path
from wattline.sources.files import file_system


def range_overlaps(ranges, keys=("device_id",)):
    """The poll ranges ``[start, start + count)`` that overlap another range of their device.

    Ranges are first reduced to one row per device and start, at most 65,536 per device; an
    overlap shows against the furthest end before it or the next start behind it, so no pairs
    are formed. An empty range overlaps where it lies strictly inside another.
    """
    keys = list(keys)
    known = ranges.withColumn("stop", F.col("start") + F.col("count"))
    full = F.when(F.col("stop") > F.col("start"), 1).otherwise(0)
    starts = known.groupBy(*keys, "start").agg(F.max("stop").alias("far"), F.sum(full).alias("same"))
    in_order = Window.partitionBy(*keys).orderBy("start")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    context = starts.select(
        *keys, "start", "same",
        F.max("far").over(before).alias("far"), F.lead("start").over(in_order).alias("next"),
    )
    stop, start = F.col("stop"), F.col("start")
    clash = (
        (F.col("far") > start) | (F.col("next") < stop) | ((F.col("same") > 1) & (stop > start))
    )
    return known.join(context, [*keys, "start"]).filter(clash).select(*known.columns)


def column_type(type_, scale):
    """Storage type of a register by its wire type and whether its scale is whole."""
    whole = scale == F.floor(scale)
    short = F.when(whole, "INTEGER").otherwise("DECIMAL(6,2)")
    return (
        F.when(type_ == "float32", "FLOAT")
        .when(type_.isin("int16", "uint16"), short)
        .when(type_ == "int32", F.when(whole, "INTEGER").otherwise("DECIMAL(10,2)"))
        .when(type_ == "uint32", F.when(whole, "BIGINT").otherwise("DECIMAL(10,2)"))
        # DECIMAL(20,0) and not BIGINT: the upper half of the 64-bit range must fit.
        .when(type_ == "uint64", F.when(whole, "DECIMAL(20,0)").otherwise("DECIMAL(20,2)"))
    )


def wide_columns(registers):
    """Wide table column and storage type of each enabled register."""
    return registers.filter("enabled").withColumn(
        "column_type", column_type(F.col("type"), F.col("scale"))
    )


def as_spark_type(column_type_name):
    """Spark type for a storage type."""
    return {"FLOAT": "double", "INTEGER": "int", "BIGINT": "bigint"}.get(
        column_type_name, column_type_name.lower()
    )


def cast_wide(wide, types):
    """A pivoted table with its columns cast, ``types`` being ``{register: storage type}``."""
    names = {column_name(register): as_spark_type(t) for register, t in types.items()}
    return wide.select(*[
        F.col(c).try_cast(names[c]).alias(c) if c in names else F.col(c) for c in wide.columns
    ])


def catalog_types(registers):
    """``{register: storage type}`` of the enabled registers of a catalog, read when the plan is made: as
    many values as the wide table has columns reach the driver. Of registers that share a name the
    first number counts."""
    named = wide_columns(registers).groupBy("name").agg(F.min_by("column_type", "register_no").alias("type"))
    return {r["name"]: r["type"] for r in named.collect()}


def rejected_values(wide, types, keys):
    """(keys, column_name, value, column_type): values that ``cast_wide`` makes null, as they are beyond
    the column's type, not numbers, or infinite. Values as text."""
    storage = {column_name(register): t for register, t in types.items()}
    lost = [
        F.when(
            F.col(c).isNotNull() & F.col(c).try_cast(as_spark_type(storage[c])).isNull(),
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
                     F.lit(storage[c]).alias("column_type")),
        )
        for c in wide.columns if c in storage
    ]
    if not lost:
        lost = [F.lit(None).cast("struct<column_name:string,value:string,column_type:string>")]
    return wide.select(*keys, F.explode(F.array_compact(F.array(*lost))).alias("lost")).select(*keys, "lost.*")


def stored_columns(spark, path, wanted=()):
    """(file, column_name, current_type): the columns of every Parquet file below a path.

    Files are listed by Spark and their footers alone are read, in tasks; types are Spark's, from the
    schema that Spark leaves in a file, else from the file's own. A column of ``wanted`` that a file
    lacks has the type null. Names are compared without regard to case. The path must be one that
    pyarrow can open on the executors (a shared folder, hdfs, s3, gs).
    """
    wanted = list(wanted)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path).select("path")
    # Listed files come many to a partition; a footer takes a round trip, so they are dealt out.
    beside = scratch_path(spark, "listed-files")
    files.write.parquet(beside)
    listed = spark.read.schema("path string").parquet(beside)
    tasks = max(1, min(listed.count() // FOOTERS + 1, MOST_TASKS))

    def run(batches):
        for batch in batches:
            rows = []
            for file in batch["path"]:
                found = footer_types(file)
                have = {c.lower() for c in found}
                rows += [(file, c, t) for c, t in found.items()]
                rows += [(file, c, None) for c in wanted if c.lower() not in have]
            yield pd.DataFrame(rows, columns=["file", "column_name", "current_type"])

    return listed.repartition(tasks).mapInPandas(run, "file string, column_name string, current_type string")


# Footers a task reads, and tasks at most (each then reads more).
FOOTERS, MOST_TASKS = 64, 10_000


def footer_types(file):
    """{column: Spark type} of one Parquet file."""
    import pyarrow.parquet as pq

    system, name = file_system(file)
    schema = pq.read_schema(name, filesystem=system)
    written = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if written:
        return {f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(written))}
    return {f.name: from_arrow_type(f.type).simpleString() for f in schema}


def stored_drift(spark, path, expected):
    """(file, column_name, current_type, expected_type): columns of the Parquet files below a path whose
    type is not the expected one, ignoring case and blanks; missing ones have a null current type.
    Columns that are not expected are let be."""
    columns = stored_columns(spark, path, expected)
    if not expected:
        return columns.withColumn("expected_type", F.lit(None).cast("string")).limit(0)
    types = F.create_map(*[F.lit(x) for name, wanted in expected.items() for x in (name.lower(), wanted)])
    known = columns.withColumn("expected_type", types[F.lower("column_name")])
    have, want = (F.lower(F.regexp_replace(c, r"\s", "")) for c in ("current_type", "expected_type"))
    drifting = F.col("expected_type").isNotNull() & ~have.eqNullSafe(want)
    return known.filter(drifting)


def drift_report(drift):
    """(column_name, current_type, expected_type, n_files, a_file): files that drift alike, together."""
    return drift.groupBy(F.lower("column_name").alias("column_name"), "current_type", "expected_type").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("file").alias("a_file"))


def schema_drift(df, expected):
    """Columns whose type is not the expected one, ignoring case and blanks; missing ones too."""
    current = {f.name.lower(): f.dataType.simpleString() for f in df.schema}
    rows = []
    for name, wanted in expected.items():
        have = current.get(name.lower())
        if have is None or _plain(have) != _plain(wanted):
            rows.append((name, have, wanted))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, current_type string, expected_type string"
    )


def _plain(type_name):
    return "".join(type_name.split()).lower()
