"""Helpers shared by the operators: written intermediate tables, words, Arrow batches."""

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wattline.session import scratch_path

# White space that separates words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

ARROW_ROWS = 512


def prepare(spark, rows=ARROW_ROWS):
    """Settings for texts: few rows in an Arrow batch, as one text may be megabytes long, and Spark's limit of bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    return spark


def materialize(df, name, **options):
    """Writes the rows below ``spark.checkpoint.dir`` and reads them back: cuts the lineage,
    survives lost executors, and freezes values that a second run might number otherwise."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_table(name, make):
    """What ``make()`` gave in this Python worker, the first time it was asked for.

    It lies in a module of the worker's own, as the globals of functions that travel with a task are
    new in every task. The table must bound its size: it stays as long as the worker does.
    """
    store = vars(sys.modules.setdefault("wattline_worker_tables", types.ModuleType("wattline_worker_tables")))
    if name not in store:
        store[name] = make()
    return store[name]


class Known(dict):
    """A table of what ``compute`` says of strings, kept once it was asked for. Strings of more than
    ``LONGEST`` letters are not kept, and a table of more than ``most_bytes`` is emptied."""

    LONGEST, ENTRY = 64, 100

    def __init__(self, compute, most_bytes):
        self.compute, self.most_bytes, self.bytes = compute, most_bytes, 0

    def __missing__(self, string):
        found = self.compute(string)
        if len(string) <= self.LONGEST:
            self.bytes += sys.getsizeof(string) + sys.getsizeof(found) + self.ENTRY
            if self.bytes > self.most_bytes:
                self.clear()
                self.bytes = 0
            self[string] = found
        return found


def numbered(df):
    """(written copy of the rows with a number each, name of the column of numbers)."""
    row = free_name(df, "row_number")
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def read_table(spark, folder, table, *columns):
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet").select(*columns)


def free_name(df, name):
    """``name``, lengthened until no column of ``df`` has it (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(text):
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def map_batches(df, function, schema):
    """``function(columns as lists by name) -> columns by name`` over Arrow batches.

    The schema is a DDL string; a function gets one batch at a time and may return any number of
    rows, so no task holds more than a batch of texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    target = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = function({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [as_array(got[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, target)


def as_array(values, kind):
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64 and pa.types.is_int64(kind):
        values = values.view(np.int64)
    return pa.array(values, kind)


def unsigned_hex(column):
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
