"""Mixing sources to target weights (operator 12) by weighted fair queueing, on DataFrame functions only.

Each source has a weight; together the sources share a budget of words. A source is given at most
``most`` times its own words, and what it leaves over is shared again by weight (``targets``). The
documents of a source stand in an order shuffled by a hash of their key, pass after pass. A queued
document has a virtual finish time: the words its source has queued up to its end, divided by the
source's target. All sources' entries are range-sorted by that time, and prefix sums over the
partitions truncate the queue at the budget. At time 1 every source has reached its target, so only
the document that is under way then is queued in pieces of ``QUANTUM`` words; all others are one entry
each. A source thus gets its target up to one piece, and the sum is the budget.

A hot source is no one task's: its rows are dealt by range of (source, hash, key, size, row). The
driver sees four sums over sources.

Null and empty texts have no words and are not taken. A null source is a source of its own, the last
one. Repeated rows and rows without a key are documents each by itself; equal (key, size) rows of a
source stand in any order, which leaves the result the same. An empty table gives no row. Columns
other than key, text and source are not looked at.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.llm.common import materialize

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
QUANTUM = 16
# White space, and a word with the white space around it.
BLANK = " \t\n\x0b\x0c\r"
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text):
    """Number of words of a text, without an array of them: each becomes one letter."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), BLANK, "")), F.lit(0)).cast("long")


def running_totals(df, order, **values):
    """Rows with ``<name>_before`` for each value: its sum over all rows ahead in the order.

    Rows are dealt by range and written; each partition is summed up by itself, and the only sum over all
    partitions sees one row of each. The order has to be total, but for rows that are alike.
    """
    rows = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(*(F.sum(v).alias(f"{k}_sum") for k, v in values.items()))
    bases = totals.select("part", *(F.coalesce(F.sum(f"{k}_sum").over(ahead), F.lit(0)).alias(f"{k}_base") for k in values))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{k}_in") for k, v in values.items()))
    return placed.join(bases, "part").select(
        *df.columns, *((F.col(f"{k}_base") + F.col(f"{k}_in")).alias(f"{k}_before") for k in values))


def sized(df, key="doc_id", text="text", source="source"):
    """Written (row, key, source, size, shuffle): each document with its words and place in the shuffle."""
    return materialize(df.select(
        F.monotonically_increasing_id().alias("row"), df[key].alias("key"), df[source].alias("source"),
        word_count(df[text]).alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(df[key].cast("string"), F.lit("")))).alias("shuffle")), "sizes")


def targets(sizes, weights=WEIGHTS, share=SHARE, most=MOST):
    """((source, place, source_size, base, target), budget): words each source is to give; base
    are the words of the sources ahead of it."""
    sums = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = running_totals(sums, [F.col("source").asc_nulls_last()], place=F.lit(1), base=F.col("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place_before") % len(weights) + 1).cast("int"))
    sources = materialize(placed.select(
        "source", F.col("place_before").alias("place"), "source_size", F.col("base_before").alias("base"),
        weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "weights")
    words, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(words or 0) * share
    # In the order of cap by weight, sources stop as long as their share of what is left reaches the cap.
    by_level = [F.col("cap") / F.col("weight"), F.col("place")]
    ahead = running_totals(sources, by_level, caps=F.col("cap"), weights=F.col("weight"))
    level = (F.lit(budget) - F.col("caps_before")) / (F.lit(all_weights or 0) - F.col("weights_before"))
    judged = materialize(ahead.withColumn("stopped", F.col("cap") <= F.col("weight") * level), "stopped")
    stopped, sharing = judged.agg(
        F.sum(F.when(F.col("stopped"), F.col("cap"))), F.sum(F.when(~F.col("stopped"), F.col("weight")))).first()
    level = (budget - (stopped or 0)) / sharing if sharing else 0.0
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return judged.select("source", "place", "source_size", "base", target.alias("target")), budget


def positions(sizes, sources):
    """Rows of ``sized`` with their source's numbers and ``start``, the words of their source ahead of them."""
    order = [F.col("source").asc_nulls_last(), "shuffle", F.col("key").asc_nulls_last(), "size", "row"]
    placed = running_totals(sizes, order, words=F.col("size"))
    named = sources.withColumnRenamed("source", "name")
    return placed.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        "row", "key", "size", "place", "source_size", "target", (F.col("words_before") - F.col("base")).alias("start"))


def queue(placed, budget, most=MOST, quantum=QUANTUM):
    """Written (row, key, place, pass, start, words, finish, words_before, taken): the queue, truncated at the budget.

    ``start`` is the place of an entry's first word in its source's stream, ``words_before`` the words
    ahead of it in the mix, ``taken`` how many of its words the mix takes.
    """
    copies = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    copies = copies.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size")).where(
        (F.col("begin") < F.col("target")) & (F.col("size") > 0))
    unit = F.when(F.col("begin") + F.col("size") <= F.col("target"), F.col("size")).otherwise(F.lit(quantum))
    cut = copies.withColumn("unit", unit)
    number = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("unit")))
    pieces = cut.select("*", F.explode(number).alias("piece")).select(
        "row", "key", "place", "pass", "target", (F.col("begin") + F.col("piece") * F.col("unit")).alias("start"),
        F.least("unit", F.col("size") - F.col("piece") * F.col("unit")).alias("words"))
    timed = pieces.where("start < target").withColumn(
        "finish", (F.col("start") + F.col("words")) / F.col("target")).drop("target")
    queued = running_totals(timed, ["finish", "place", "start"], words=F.col("words"))
    left = F.lit(int(budget)) - F.col("words_before")
    return queued.withColumn("taken", F.greatest(F.lit(0), F.least(left, F.col("words"))))


def mix(df, weights=WEIGHTS, share=SHARE, most=MOST, key="doc_id", text="text", source="source"):
    """(key, size, source_size, target, taken): the words of each document that the mix takes."""
    sizes = sized(df, key, text, source)
    sources, budget = targets(sizes, weights, share, most)
    placed = materialize(positions(sizes, sources), "positions")
    # Entries of a source leave the queue in their order, so what it gave is the first part of its stream.
    given = queue(placed, budget, most).groupBy("place").agg(F.sum("taken").alias("given"))
    # Written, so that its size is known before the join is planned: few sources go to the documents.
    rows = placed.join(materialize(given, "given"), "place", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    taken = sum((
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("given") - F.col("start") - i * F.col("source_size")))
        for i in range(most)), F.lit(0).cast("long"))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


def mixed_texts(df, weights=WEIGHTS, share=SHARE, most=MOST, key="doc_id", text="text", source="source"):
    """(position, key, pass, first_word, words): the mix itself in its order; position is the number of
    words ahead, first_word the place of the entry's first word in its document."""
    sizes = sized(df, key, text, source)
    sources, budget = targets(sizes, weights, share, most)
    placed = materialize(positions(sizes, sources), "positions")
    begun = placed.select("row", F.col("start").alias("own"), "source_size")
    entries = queue(placed, budget, most).where("taken > 0").join(begun, "row")
    first = F.col("start") - F.col("own") - F.col("pass") * F.col("source_size")
    return entries.select(F.col("words_before").alias("position"), F.col("key").alias(key), "pass",
                          first.alias("first_word"), F.col("taken").alias("words"))
