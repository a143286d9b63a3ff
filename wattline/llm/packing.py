"""Packing (operator 5): concatenate all documents and cut the stream of ids at fixed windows.

First pass: every task turns its texts into ids, with a running offset inside the task, and writes
them to a table together with its own number. The sum of a task's ids is its total; prefix sums over
the totals give each task its place in the stream. Second pass: with that place every document knows
its own global offset and is cut where the stream crosses a multiple of the sequence length. The
pieces are the boundary records: only the last sequence of all can be short.

The ids are those of the tokenizers library; a table of words encoded before makes them in a fraction
of its time (see ``bpe``, whose tests compare the two).

Null and empty texts have the end id alone. An empty table gives no piece. Repeated rows are packed
each by itself; columns other than key and text are not looked at.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.llm.bpe import tokenizer
from wattline.llm.common import map_batches, materialize

LENGTH, END = 2048, 1
# Tasks whose totals one task adds up in order; the blocks' sums are one row for so many tasks.
BLOCK = 1024
# So many tasks' offsets, 16 bytes each, are sent to every executor at most.
MOST_SENT = 1_000_000
def tokenized(df, path, text="text", key="doc_id", end=END):
    """Written table (part, start, key, tokens, ids): ids of every row, its task, and the ids of
    that task before it. Written once, so the places stay as they are whatever runs again."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        table = tokenizer(path)
        last = table.packed([end])
        size = len(last)
        for batch in batches:
            ids = [table.encoded(x) + last for x in batch.column(1).to_pylist()]
            counts = np.array([len(x) // size for x in ids], np.int64)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), batch.column(0),
                 pa.array(counts), pa.array(ids, pa.binary())],
                names=["part", "start", "key", "tokens", "ids"],
            )

    kind = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("key"), df[text].alias("text"))
    schema = f"part int, start long, key {kind}, tokens long, ids binary"
    return materialize(picked.mapInArrow(run, schema), "tokens")


def part_offsets(tokens):
    """Written table (part, before): ids in all tasks before each task.

    Totals are one row per task. They are added up by blocks of tasks, so that the only sum over
    all rows sees one row for every 1,024 tasks.
    """
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("n"))
    totals = totals.withColumn("block", F.floor(F.col("part") / BLOCK))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select(
        "block", F.coalesce(F.sum("n").over(earlier.orderBy("block")), F.lit(0)).alias("base")
    )
    inside = F.coalesce(F.sum("n").over(earlier.partitionBy("block").orderBy("part")), F.lit(0))
    placed = totals.join(blocks, "block").select("part", (F.col("base") + inside).alias("before"))
    return materialize(placed, "offsets")


def pieces(tokens, key="doc_id", length=LENGTH, with_ids=True):
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    wanted, the ids themselves."""
    kind = tokens.schema["key"].dataType.simpleString()

    def run(batch):
        ids = batch["ids"].to_pylist()
        counts = np.asarray(batch["tokens"])
        first = np.asarray(batch["before"]) + np.asarray(batch["start"])
        row, start, size, crc, cut = [], [], [], [], []
        for i, x in enumerate(ids):
            n, g = int(counts[i]), int(first[i])
            x = np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4")
            a = 0
            while a < n:
                b = min(n, a + length - (g + a) % length)
                row.append(i)
                start.append(a)
                size.append(b - a)
                crc.append(zlib.crc32(x[a:b].tobytes()))
                cut.append(x[a:b].astype(np.int32) if with_ids else None)
                a = b
        row, start = np.array(row, np.int64), np.array(start, np.int64)
        place = first[row] + start
        out = {
            "key": batch["key"].take(pa.array(row)), "start": start, "length": np.array(size, np.int64),
            "ids_crc32": np.array(crc, np.int64), "doc_tokens": counts[row],
            "sequence_id": place // length, "offset": place % length,
        }
        return out | ({"ids": cut} if with_ids else {})

    schema = f"""key {kind}, start long, length long, ids_crc32 long, doc_tokens long,
        sequence_id long, offset long""" + (", ids array<int>" if with_ids else "")
    offsets = part_offsets(tokens)
    # One row of two numbers for each task; beyond the bound the rows are joined by shuffling.
    if offsets.count() <= MOST_SENT:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part")
    return map_batches(placed, run, schema).withColumnRenamed("key", key)


def pack(df, path, text="text", key="doc_id", length=LENGTH, end=END, with_ids=True):
    """Packs every row's text; ``with_ids=False`` leaves out the ids of each piece."""
    return pieces(tokenized(df, path, text, key, end), key, length, with_ids)
