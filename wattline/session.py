"""Session defaults and the shared folder for intermediate tables."""

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings that queries rely on (UTC) or run better with. HotSpot leaves methods above 8,000 bytes
# uncompiled; with the limit, Spark falls back to its split-up code for such (wide) stages. With a limit of bytes
# Spark adds up the size of all columns of an Arrow batch at every row, which took more time than writing the row; rows
# here are short, and their number bounds a batch (``wattline.llm`` puts the limit back for its long texts).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2147483647",
}


def build_session(app="wattline", master=None, **conf):
    """A session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark):
    """Puts the settings on a session that is already there; they stay on it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark):
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder instead, one for the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder()


@functools.cache
def _local_folder():
    return tempfile.mkdtemp(prefix="wattline-")


@contextlib.contextmanager
def freed_shuffles(spark):
    """Shuffle files of a write inside go with the end of that write, not with the driver's next garbage
    collection; so steps that follow each other do not add up on disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_path(spark, name):
    """A new path below the shared folder, different at every call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
