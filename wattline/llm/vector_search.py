"""Exact top-k search (operator 7) by vector-approximation files.

Vectors are whole numbers (floor of 256 times each component); the score is the inner product. Equal
vectors form a class and are searched once; a class keeps the rows of its smallest ids only, which are
all that can be among the best, so a very common vector is one class with a few ids. The approximation
file holds a cell of one byte for each component: the component's range in the table is cut into 256
equal cells. With q a query, the score of a vector is within sum |q_d| * w_d / 2 of the inner product
with its cells' centres, w_d being the width of a cell.

1. The approximations are scanned, in blocks against blocks of queries. Each block pair gives, for each
   query, the candidates whose upper bound reaches the k-th best lower bound seen in that pair.
2. The k-th best lower bound of all pairs removes most of those.
3. Exact vectors are read by falling upper bound: first those of a query's k greatest bounds, whose k-th
   exact score is a floor; then only those whose bound reaches that floor. Below it nothing is read.

A query asks for as many classes more than k as its own id has vectors, since classes of its own rows
alone answer nothing; that number is each query's own, so an id that is repeated costs no other query.

Bounds are computed in double precision and widened by what rounding can take; where they overflow, a
candidate is kept. The result is exact. Ties go to the smaller id. Rows without an id, null vectors,
empty ones and those with null or non-finite components take no part. Vectors of different length never
meet. Every row counts: rows that repeat id and vector are as many candidates. No row answers a query of
its own id; the vectors of an id that is repeated ask together, each as often as it is there, and get the
``k`` best of all their scores. Scores beyond 64 bits are given as the nearest 64-bit number, and
components that 256 times are beyond a double as the nearest double. An empty table gives no row.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.llm.common import materialize

CELLS = 256
# Classes and queries in a block.
ROWS, QUERIES = 2048, 256
# Share of the sum of products' sizes that rounding can take from a score: far above components * 2 ** -53.
ROUNDING = 1e-10


def whole_vectors(df, vector="embedding", key="vec_id"):
    """Written (vec_id, v, size) of the rows that take part; v is an array of whole numbers, as doubles."""

    def whole(x):
        large = x.cast("double") * 256
        # From 2 ** 53 on every double is whole; below, a long holds the floor, which has no -0.
        fine = F.when(F.abs(large) < 2.0**53, F.floor(large).cast("double")).otherwise(large)
        return F.greatest(F.least(fine, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))

    parts = F.transform(df[vector], lambda x: x.cast("double"))
    fine = ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(df[key].isNotNull() & df[vector].isNotNull() & (F.size(df[vector]) > 0) & fine)
    rows = rows.select(df[key].cast("long").alias("vec_id"), F.transform(df[vector], whole).alias("v"))
    return materialize(rows.withColumn("size", F.size("v")), "vectors")


def classes_of(vectors, k):
    """Written (class, v, size, ids): the distinct vectors with the rows of their ``k`` + 1 smallest ids,
    each at most ``k`` times: without any one id the ``k`` first are still there."""
    counted = vectors.groupBy("v", "size", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("v", "size").orderBy("vec_id"))
    few = counted.withColumn("place", place).where(F.col("place") <= k + 1)
    copies = F.array_repeat("vec_id", F.least("n", F.lit(k)).cast("int"))
    grouped = few.groupBy("v", "size").agg(F.flatten(F.collect_list(copies)).alias("ids"))
    return materialize(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")


def ranges(vectors):
    """Written (size, low, width): for each length of vectors and each component the least value and
    the width of a cell, as arrays."""
    ends = vectors.select("size", F.posexplode("v").alias("at", "x")).groupBy("size", "at").agg(
        F.min("x").alias("low"), F.max("x").alias("high"))
    width = F.greatest(F.col("high") / CELLS - F.col("low") / CELLS, F.lit(1e-9))
    lists = ends.withColumn("width", width).groupBy("size").agg(
        F.sort_array(F.collect_list(F.struct("at", "low", "width"))).alias("all"))
    return materialize(lists.select("size", F.col("all.low").alias("low"), F.col("all.width").alias("width")), "ranges")


def approximations(classes, bounds):
    """Written (class, size, cells): the approximation file, a byte for each component."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            column = {n: batch.column(i) for i, n in enumerate(names)}
            sizes = np.asarray(column["size"])
            cells = [None] * len(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                v = flat(column["v"], at, size)
                low, width = (np.array(column[c][int(at[0])].as_py()) for c in ("low", "width"))
                # Divided first, as a difference may be beyond a double.
                found = np.clip(v / width - low / width, 0, CELLS - 1).astype(np.uint8)
                for i, x in zip(at.tolist(), found, strict=True):
                    cells[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [column["class"], column["size"], pa.array(cells, pa.binary())], names=["class", "size", "cells"])

    placed = classes.join(bounds, "size").select("class", "size", "v", "low", "width")
    return materialize(placed.mapInArrow(run, "class long, size int, cells binary"), "approximations")


def flat(lists, at, size):
    """Rows ``at`` of a list column as a matrix."""
    picked = lists.take(pa.array(at))
    return picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)


def blocks(rows, per_block, *values):
    """Rows packed by the block and size: (size, block, ids, packed values); a block is bounded in size, as
    rows fall into it by hash."""
    n = rows.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("blocks"))
    numbered = rows.join(materialize(n, "block-counts"), "size").withColumn(
        "block", F.pmod(F.xxhash64("class"), "blocks"))
    return numbered.groupBy("size", "block", "blocks").agg(F.collect_list(F.struct("class", *values)).alias("rows"))


def bounded(queries, files, bounds):
    """(query, need, class, low, high): candidate classes of each query class, with bounds of their scores.
    ``need`` is the number of best classes that the query asks for."""
    asked = materialize(blocks(queries, QUERIES, "v", "need").select(
        "size", F.col("block").alias("query_block"), F.col("blocks").alias("query_blocks"),
        F.col("rows").alias("asked")), "query-blocks")
    numbers = asked.groupBy("size").agg(F.max("query_blocks").alias("query_blocks"))
    held = blocks(files, ROWS, "cells").select("size", F.col("rows").alias("held")).join(numbers, "size")
    # Every block of approximations meets every block of the stated queries.
    pairs = held.select("size", "held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias(
        "query_block")).join(asked, ["size", "query_block"]).join(bounds, "size").select(
        "size", "held", "asked", "low", "width")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                low, width = (np.array(batch.column(c)[i].as_py()) for c in ("low", "width"))
                held, asked = batch.column("held")[i].values, batch.column("asked")[i].values
                ids = held.field("class").to_numpy()
                cells = np.frombuffer(b"".join(held.field("cells").to_pylist()), np.uint8).reshape(-1, size)
                asks = asked.field("class").to_numpy()
                q = flat(asked.field("v"), np.arange(len(asks)), size)
                need = asked.field("need").to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    score = q @ (low + (cells + 0.5) * width).T
                    reach = np.maximum(np.abs(low), np.abs(low + CELLS * width))
                    slack = (np.abs(q) @ width / 2 + np.abs(q) @ reach * ROUNDING + 1)[:, None]
                    least, most = score - slack, score + slack
                # Where doubles overflow, nothing is known.
                unknown = ~(np.isfinite(least) & np.isfinite(most))
                least[unknown], most[unknown] = -np.inf, np.inf
                floor = np.full(len(asks), -np.inf)
                for k in np.unique(need[need <= len(ids)]).tolist():
                    alike = need == k
                    floor[alike] = np.partition(least[alike], -k, axis=1)[:, -k]
                # Lower bound of the k-th best against the upper bound of each.
                a, b = np.nonzero(most >= floor[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asks[a]), pa.array(need[a]), pa.array(ids[b]), pa.array(least[a, b]), pa.array(most[a, b])],
                    names=["query", "need", "class", "low", "high"])

    return pairs.mapInArrow(run, "query long, need long, class long, low double, high double")


def exact(pairs, queries, classes):
    """(query, need, class, score): exact scores of pairs (query, need, class). Each pair is scored by
    itself, wherever Spark has put it, so the pairs of one query need not come together."""

    def run(batches):
        for batch in batches:
            q, v = batch.column("q"), batch.column("v")
            scores = [inner(q[i].values.to_numpy(), v[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("query", "need", "class")), pa.array(scores, pa.int64())],
                names=["query", "need", "class", "score"])

    asked = pairs.select("query", "need", "class").join(
        queries.select(F.col("class").alias("query"), F.col("v").alias("q")), "query")
    return asked.join(classes.select("class", "v"), "class").select("query", "need", "class", "q", "v").mapInArrow(
        run, "query long, need long, class long, score long")


def inner(q, v):
    """Inner product of whole numbers, as the nearest long."""
    # No partial sum is beyond 2 ** 53 here, so each is whole in doubles.
    if np.abs(q).max() * np.abs(v).max() * len(q) < 2.0**53:
        return int(q @ v)
    return min(max(sum(int(a) * int(b) for a, b in zip(q.tolist(), v.tolist(), strict=True)), -(2**63)), 2**63 - 1)


def nth_best(rows, column):
    """(query, floor): the value that ``need`` rows of a query reach, null if it has fewer rows."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(column)))
    few = rows.select("query", "need", column, place.alias("place")).where(F.col("place") <= F.col("need"))
    return few.groupBy("query").agg(
        F.when(F.count(F.lit(1)) == F.max("need"), F.min(column)).alias("floor"))


def top_k(df, is_query, k=5, vector="embedding", key="vec_id"):
    """(query_id, rank, vec_id, score): the ``k`` best of every query; ``is_query`` is a condition on
    column ``vec_id``."""
    vectors = whole_vectors(df, vector, key)
    classes = classes_of(vectors, k)
    bounds = ranges(classes)
    files = approximations(classes, bounds)
    # Query rows that repeat id and vector count as often as they can tell.
    asked = vectors.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "v").agg(
        F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    asking = materialize(asked.join(classes.select("v", F.col("class").alias("query")), "v").drop("v"), "asking")
    own = asking.groupBy("query_id").agg(F.count(F.lit(1)).alias("own"))
    needs = asking.join(own, "query_id").groupBy(F.col("query").alias("class")).agg((F.max("own") + k).alias("need"))
    queries = materialize(classes.join(needs, "class").select("class", "v", "size", "need"), "queries")
    found = materialize(bounded(queries, files, bounds), "bounded")
    # The k-th best lower bound over all blocks; a query has few candidates left in each of them.
    left = materialize(found.join(nth_best(found, "low"), "query").where("floor IS NULL OR high >= floor").select(
        "query", "need", "class", "high"), "left")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "class"))
    first = left.withColumn("place", place).where(F.col("place") <= F.col("need"))
    scored = materialize(exact(first, queries, classes), "scored-first")
    # What is certain to be no better than the k-th score is never read.
    rest = left.join(nth_best(scored, "score"), "query").where("high >= floor").join(
        scored.select("query", "class"), ["query", "class"], "left_anti")
    scored = scored.unionByName(exact(rest, queries, classes))
    best = scored.withColumn("n", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(
        F.col("n") <= F.col("need")).join(classes.select("class", "ids"), "class").select(
        "query", "score", F.explode("ids").alias("vec_id"))
    answers = materialize(best, "answers").join(asking, "query").where("vec_id <> query_id")
    answers = answers.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    ranked = answers.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
