"""Connected components of an edge table, by alternating large and small stars (Kiveris et al. 2014)."""

from pyspark.sql import functions as F

from wattline.llm.common import materialize


def hooked(edges, larger_only):
    """Edges from each node's neighbours to the least of the node and its neighbours.

    The minima are written first: a join of two plain tables can be split where a node has very
    many neighbours.
    """
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("m", "u").alias("m")), "least")
    joined = edges.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges):
    """(node, root) of every node of ``edges`` (u, v: long); root is its component's least node.

    Every round is written; no link leaves the executors. Only the number of edges and a checksum
    come back, to see whether a round changed anything.
    """
    loop_free = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, seen = materialize(loop_free, "edges"), None
    while True:
        # bit_xor of hashes cannot overflow, unlike a sum.
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hooked(both, larger_only=True).where("u <> v").distinct()
        small = hooked(large, larger_only=False).where("u <> v").distinct()
        current = materialize(small, "edges")
