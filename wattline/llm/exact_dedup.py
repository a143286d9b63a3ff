"""Exact dedup (operator 9) by deterministic block naming.

Two texts are equal when they are identical after every run of white space became one space. Each
normalised text is cut into blocks of 8,192 characters. The distinct blocks, sorted, get integer
names; then adjacent pairs of names are named in the same way, level by level, until every document
has one name. Equal names at the same level mean equal texts: a name stands for one block or one
pair, so nothing can collide.

Blocks are found again by digest instead of by content, so that texts are shuffled once, after
copies inside a task were merged. That is exact because it is checked: the digests of all distinct
blocks are counted, and if two blocks shared one, the digest gets longer until none do.

Null texts count as empty and equal empty ones. Of equal rows, also if they repeat a key, one stays:
the one with the smallest key, a null key only if there is no other. An empty table gives no row.
"""

from itertools import count

from pyspark.sql import functions as F

from wattline.llm.common import SPACE, materialize, numbered

BLOCK = 8192
NONE = -1  # stands for the missing right half of an odd pair


def normalized(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def blocks_of(text):
    """The text in pieces of 8,192 characters; an empty text is one empty piece."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def digests(column, n):
    return {f"d{i}": F.xxhash64(column, F.lit(i)) for i in range(n)}


def block_names(texts, n):
    """Written (digests, name) of the distinct blocks; a partition's blocks are sorted, and the name
    is the place in that order after the number of the partition."""
    distinct = texts.select(F.explode(blocks_of(F.col("text"))).alias("block")).distinct()
    named = distinct.sortWithinPartitions("block").select(
        *[c.alias(k) for k, c in digests(F.col("block"), n).items()],
        F.monotonically_increasing_id().alias("name"),
    )
    return materialize(named, "block-names")


def pair_names(pairs):
    """Written (a, b, name) of the distinct pairs, named like blocks."""
    distinct = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
    return materialize(distinct.withColumn("name", F.monotonically_increasing_id()), "pair-names")


def identities(df, text="text", key="doc_id", row=None):
    """Written (row, key, sha256, level, name): equal (level, name) means equal texts.

    ``row`` is a column of row numbers; without it, the rows are numbered as they are read.
    """
    number = df[row] if row else F.monotonically_increasing_id()
    texts = df.select(number.alias("row"), df[key].alias("key"), normalized(df[text]).alias("text"))
    for n in count(2):
        names = block_names(texts, n)
        known = [f"d{i}" for i in range(n)]
        if names.select(*known).distinct().count() == names.count():
            break
    placed = texts.select(
        "row", "key", F.sha2("text", 256).alias("sha256"), blocks_of(F.col("text")).alias("blocks"),
    ).select("row", "key", "sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
    first = F.col("at") == 0
    placed = materialize(placed.select(
        "row", "at", "n", F.when(first, F.col("key")).alias("key"),
        F.when(first, F.col("sha256")).alias("sha256"),
        *[c.alias(k) for k, c in digests(F.col("block"), n).items()],
    ), "blocks")
    heads = placed.where(first).select("row", "key", "sha256")
    most = placed.agg(F.max("n")).first()[0] or 0
    current = placed.join(names, known).select("row", "at", "n", "name")
    done, level = [], 0
    while True:
        current = materialize(current, "named")
        done.append(current.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        even = F.col("at") % 2 == 0
        pairs = materialize(
            current.where("n > 1").groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("b"),
                F.ceil(F.max("n") / 2).alias("n"),
            ), "pairs")
        current = pairs.join(pair_names(pairs), ["a", "b"]).select("row", "at", "n", "name")
        most, level = -(-most // 2), level + 1
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return materialize(heads.join(named, "row"), "identities")


def decisions(df, text="text", key="doc_id", row=None):
    """(row, key, keep_id, group_size, kept, text_sha256): one row for every row of the table."""
    rows = identities(df, text, key, row)
    groups = materialize(rows.groupBy("level", "name").agg(
        F.min("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.min_by("row", "key"), F.min("row")).alias("keep_row"),
    ), "groups")
    return rows.join(groups, ["level", "name"]).select(
        "row", "key", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def exact_duplicates(df, text="text", key="doc_id"):
    """(key, keep_id, group_size, kept, text_sha256): one row for every row of the table."""
    return decisions(df, text, key).drop("row").withColumnRenamed("key", key)


def drop_exact_duplicates(df, text="text", key="doc_id"):
    """The rows that stay, with all their columns. The rows that go are taken out by number: they are
    the fewer, so Spark can often send them to the texts instead of shuffling texts."""
    copy, row = numbered(df)
    gone = decisions(copy, text, key, row).where(~F.col("kept")).select(F.col("row").alias(row))
    return copy.join(materialize(gone, "gone"), row, "left_anti").drop(row)
