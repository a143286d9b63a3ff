"""Imports whose lines are put in order before they become a row for each register."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattline.operators.changes import change_filter
from wattline.sources.wide import import_long, unpivot_table

KNOWN = ["a", "b", "c(n)"]


def lines(spark, seed, n=600):
    """Lines of three files over months: blank and unreadable times, values that repeat, are zero, NaN or no numbers."""
    r = random.Random(seed)
    times = ["", " ", None, "soon-ish", *[f"2024-{m:02}-{d:02} 10:00:00" for m in (1, 2, 5) for d in (1, 9, 28)]]
    data = [
        (r.choice(["f", "g", "h", None]), i, r.choice(times), r.choice([None, 0.0, 1.0, 1.0, 2.0, float("nan")]),
         r.choice([None, "", "0", "5", " 5 ", "5.0", "x"]), r.choice([0, 3]))
        for i in range(n)]
    return spark.createDataFrame(data, "file string, line_no long, Time string, `a/101` double, `b/102` string, `c(n)/103-104` int")


def texts(df):
    """Rows with the value as text, as NaN equals nothing."""
    return rows(df.withColumn("value", F.col("value").cast("string")))


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_lines_import_as_ordered_rows(spark, seed):
    df = lines(spark, seed)
    long = unpivot_table(df, KNOWN, previous=True)
    want = import_long(unpivot_table(df, KNOWN))
    assert want.count() > 50
    assert texts(import_long(long)) == texts(want)
    # The value before is that of the register, in the line before in its file.
    kept = change_filter(long.drop("previous"), ["file", "register_name"], ("timestamp", "block", "line_no"))
    changed = long.filter(F.col("previous").isNull() | F.isnan("value") | (F.col("value") != F.col("previous")) | F.col("value").isNull())
    assert texts(changed.drop("previous")) == texts(kept)


def test_columns_of_one_name_are_one_series(spark):
    data = [("f", 1, "2024-01-01 10:00:00", 1.0, None), ("f", 2, "2024-01-02 10:00:00", None, 1.0)]
    df = spark.createDataFrame(data, "file string, line_no long, Time string, `a/101` double, `a/102` double")
    long = unpivot_table(df, ["a"], previous=True)
    assert "previous" not in long.columns
    assert rows(import_long(long)) == rows(import_long(unpivot_table(df, ["a"])))
    none = unpivot_table(df, ["b"], previous=True)
    assert (none.columns[-1], none.count()) == ("previous", 0)


def test_an_import_shuffles_lines_once_and_reads_them_once(spark):
    from registered_queries import QUERIES

    plan = QUERIES["wide_import"](spark, "/root/testdata/sf0.001")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    # A row for each register is made behind the shuffle; both uses of the ordered lines read one shuffle.
    assert "hashpartitioning(file#" in text and "register_name" not in "".join(x for x in text.splitlines() if "hashpartitioning" in x)
    assert text.count("Scan parquet") == 1 and "ReusedExchange" in text
