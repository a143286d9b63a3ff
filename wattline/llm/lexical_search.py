"""Ranked lexical search (operator 11) by presence masks.

Items (queries) come in chunks of a bounded size; a chunk's distinct terms are numbered. One pass over
the documents turns them into blocks: for each of the chunk's terms its documents of the block and
how often it occurs there, and the block's counts. The counts of all blocks give the statistics of the
whole table. A second pass ranks the blocks:

1. For each item, the bitmaps of its terms over the block's documents are put side by side, so that
   every document has a mask of the terms that it matches; documents are grouped by mask.
2. A mask's greatest score is the sum, over its terms, of weight times the greatest share that the
   term has in any document of the block.
3. Masks are evaluated by falling greatest score, until the next one is below the k-th best score that
   the task has found for the item so far. Equality goes on, as ties go to the smaller id.

A task gives at most k documents for each item, and the k best of all tasks are the answer. The work
of an item is spread over all blocks, however many documents hold its terms.

Terms are runs of letters and digits, other than ASCII signs; only A-Z are lowered. Null and empty
texts have no term. Rows that repeat are documents, or items, each by itself; rows of documents
without an id take no part in the answer, but count in the statistics. An item without terms, an empty
table of documents and an empty one of items give no row. Columns other than ids and texts are not
looked at.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.llm.common import materialize, prepare, text_bytes

TOP, SLOPE = 10, 75
# Blocks in an Arrow batch, as a block is some megabytes long.
ARROW_BLOCKS = 4
# Documents and postings in a block, and cells of the matrix of an item's terms by documents.
DOCUMENTS, POSTINGS, CELLS = 16_384, 500_000, 2_000_000
# Bytes of item texts in a chunk; a chunk's terms go to every task.
CHUNK_BYTES = 16 << 20

# Byte by byte: signs become blanks, A-Z are lowered, all else (bytes of other letters too) stays.
FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256))


def terms(text):
    """The terms of a text, in order, as UTF-8."""
    return text_bytes(text).translate(FOLD).split()


def item_chunks(items, text="text", key="item_id", most_bytes=CHUNK_BYTES):
    """Lists of (id, {term: times}), each of a bounded size in bytes, that together hold every item."""
    rows = materialize(items.select(items[key].alias("key"), items[text].alias("text")).withColumn(
        "row", F.monotonically_increasing_id()), "items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = size // most_bytes + 1
    for i in range(chunks):
        held = rows if chunks == 1 else rows.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == i)
        yield [(r.key, Counter(terms(r.text))) for r in held.toLocalIterator() if r.text]


class Block:
    """Documents of one task, gathered up to a bound: postings by column (term) and place."""

    def __init__(self, width):
        self.width = width
        self.clear()

    def clear(self):
        self.ids, self.lengths, self.columns, self.places, self.times, self.unnamed = [], [], [], [], [], []
        self.documents = self.words = 0

    def add(self, key, text, numbers):
        found = terms(text)
        if not found:
            return
        self.documents += 1
        self.words += len(found)
        counts = Counter(found)
        held = [t for t in counts if t in numbers]
        if key is None:
            self.unnamed.extend(numbers[t] for t in held)
        if key is None or not held:
            return
        place = len(self.ids)
        self.ids.append(key)
        self.lengths.append(len(found))
        self.columns.extend(numbers[t] for t in held)
        self.places.extend([place] * len(held))
        self.times.extend(counts[t] for t in held)

    def full(self):
        return len(self.ids) >= DOCUMENTS or len(self.columns) + len(self.unnamed) >= POSTINGS

    def row(self, part):
        """The block as one row of a record batch; postings lie by column, then place."""
        columns, places = np.array(self.columns, np.int32), np.array(self.places, np.int32)
        order = np.lexsort((places, columns))
        holding = np.bincount(columns, minlength=self.width)
        every = holding + np.bincount(np.array(self.unnamed, np.int32), minlength=self.width)
        values = [part, self.documents, self.words, self.ids, self.lengths, every.astype("<i4").tobytes(),
                  holding.astype("<i4").tobytes(), places[order].astype("<i4").tobytes(),
                  np.array(self.times, "<i8")[order].tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)


BLOCK_NAMES = ["part", "documents", "words", "ids", "lengths", "counts", "holding", "places", "times"]
BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
               pa.binary(), pa.binary(), pa.binary(), pa.binary()]
BLOCK_SCHEMA = """part int, documents long, words long, ids array<long>, lengths array<long>,
    counts binary, holding binary, places binary, times binary"""


def blocks_of(docs, numbers, text="text", key="doc_id"):
    """Written table of blocks; ``numbers`` is the column of each term."""

    def run(batches):
        part, block = TaskContext.get().partitionId(), Block(len(numbers))
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(k, t.as_py(), numbers)
                if block.full():
                    yield block.row(part)
                    block.clear()
        if block.documents:
            yield block.row(part)

    picked = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return materialize(picked.mapInArrow(run, BLOCK_SCHEMA), "blocks")


def statistics(blocks, width):
    """(documents with a term, terms of all documents, documents that hold each term), over all blocks."""
    documents, words = blocks.agg(F.sum("documents"), F.sum("words")).first()

    def run(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), "<i4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    counted = blocks.select("counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    holding = np.zeros(width, np.int64)
    for r in counted.collect():  # one row a term of the chunk
        holding[r.term] = r.n
    return documents or 0, words or 0, holding


def weights_of(documents, holding):
    """Whole-number weight of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()], np.int64)


def shares(times, lengths, documents, words):
    """What a term that occurs ``times`` in a document of that length adds, before its weight."""
    if len(lengths) and int(lengths.max()) * SLOPE * documents >= 1 << 63:
        scaled = np.array([SLOPE * n * documents // words for n in lengths.tolist()], np.int64)
    else:
        scaled = SLOPE * lengths * documents // max(words, 1)
    return 1_000_000_000 * times // (1000 * times + 8 * (100 - SLOPE + scaled))


class Impacts:
    """A block ready to be ranked: for each term its documents and shares."""

    def __init__(self, row, documents, words):
        self.ids = row["ids"]
        holding = np.frombuffer(row["holding"], "<i4")
        self.ends = np.concatenate([[0], np.cumsum(holding, dtype=np.int64)])
        self.places = np.frombuffer(row["places"], "<i4")
        self.shares = shares(np.frombuffer(row["times"], "<i8"), row["lengths"][self.places], documents, words)

    def ranked(self, columns, factors, k, best):
        """Puts the item's better documents into ``best``, a falling list of (score, -id)."""
        here = [(self.ends[c], self.ends[c + 1], f) for c, f in zip(columns, factors, strict=True)
                if f and self.ends[c] < self.ends[c + 1]]
        if not here:
            return best
        span = max(64, CELLS // len(here))
        for first in range(0, len(self.ids), span):
            best = self.slice_ranked(here, first, min(first + span, len(self.ids)), k, best)
        return best

    def slice_ranked(self, here, first, last, k, best):
        """The same for documents ``first`` to ``last`` of the block."""
        # Bitmaps of the terms side by side: one row of bits, the mask, for each document.
        matrix = np.zeros((len(here), last - first), np.int64)
        for i, (a, b, _) in enumerate(here):
            places = self.places[a:b]
            if last - first < len(self.ids):
                low, high = np.searchsorted(places, (first, last))
                a, places = a + low, places[low:high]
            matrix[i, places - first] = self.shares[a : a + len(places)]
        bits = np.packbits(matrix > 0, axis=0)
        width = -(-len(bits) // 8)
        words = np.zeros((last - first, width * 8), np.uint8)
        words[:, : len(bits)] = bits.T
        masks, group = distinct(words.view("<u8"))
        present = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1, count=len(here)).astype(bool)
        factor = np.array([f for _, _, f in here], np.int64)
        most = present @ (factor * matrix.max(axis=1))
        # Documents by falling greatest score of their mask.
        falling = np.argsort(-most, kind="stable")
        rank = np.empty(len(masks), np.int64)
        rank[falling] = np.arange(len(masks))
        order = np.argsort(rank[group], kind="stable")
        ends = np.cumsum(np.bincount(rank[group], minlength=len(masks)))
        most, done, step = most[falling], 0, 1
        while done < len(masks) and most[done] > 0 and (len(best) < k or most[done] >= best[-1][0]):
            # The masks that share this step's bound or follow it: as many as were looked at so far.
            upto = min(len(masks), done + step)
            docs = order[ends[done - 1] if done else 0 : ends[upto - 1]]
            score = factor @ matrix[:, docs]
            if len(best) == k:
                near = score >= best[-1][0]
                docs, score = docs[near], score[near]
            if len(docs) > k:
                least = np.partition(score, -k)[-k]
                docs, score = docs[score >= least], score[score >= least]
            found = [(s, -self.ids[first + d]) for d, s in zip(docs.tolist(), score.tolist(), strict=True) if s > 0]
            best = sorted([*best, *found], reverse=True)[:k]
            done, step = upto, upto
        return best


def distinct(words):
    """(distinct rows, place of each row among them) of a matrix of unsigned numbers."""
    order = np.lexsort(words.T[::-1])
    ordered = words[order]
    new = np.ones(len(words), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    group = np.empty(len(words), np.int64)
    group[order] = np.cumsum(new) - 1
    return np.ascontiguousarray(ordered[new]), group


def best_of_tasks(blocks, queries, documents, words, k=TOP):
    """(item, key, score): the k best documents of each item in each task; ``queries`` holds (columns,
    factors) of each item."""

    def run(batches):
        best = [[] for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in ("ids", "lengths", "holding", "places", "times")}
                ids = row["ids"].as_py()
                if not ids:
                    continue
                impacts = Impacts({"ids": ids, "lengths": row["lengths"].values.to_numpy(),
                                   **{n: row[n].as_buffer() for n in ("holding", "places", "times")}}, documents, words)
                for q, (columns, factors) in enumerate(queries):
                    best[q] = impacts.ranked(columns, factors, k, best[q])
        found = [(q, -key, score) for q, rows in enumerate(best) for score, key in rows]
        parts = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["item", "key", "score"])

    picked = blocks.where("size(ids) > 0").select("ids", "lengths", "holding", "places", "times")
    return picked.mapInArrow(run, "item long, key long, score long")


def search(docs, items, k=TOP, text="text", key="doc_id", item_key="item_id", chunk_bytes=CHUNK_BYTES):
    """(item_key, rank, key, score): the ``k`` best documents of every item, ties by smaller id."""
    found = None
    for chunk in item_chunks(items, text, item_key, chunk_bytes):
        numbers = {t: i for i, t in enumerate(sorted({t for _, counts in chunk for t in counts}))}
        prepare(docs.sparkSession)
        blocks = blocks_of(docs, numbers, text, key)
        prepare(docs.sparkSession, ARROW_BLOCKS)
        documents, words, holding = statistics(blocks, len(numbers))
        weight = weights_of(documents, holding)
        queries = []
        for _, counts in chunk:
            columns = [numbers[t] for t in counts]
            queries.append((columns, [n * int(weight[c]) for c, n in zip(columns, counts.values(), strict=True)]))
        names = docs.sparkSession.createDataFrame(
            [(i, x) for i, (x, _) in enumerate(chunk)], f"item long, name {items.schema[item_key].dataType.simpleString()}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))
        best = best_of_tasks(blocks, queries, documents, words, k).withColumn("rank", place).where(F.col("rank") <= k)
        part = materialize(best, "best").join(names, "item").select(
            F.col("name").alias(item_key), "rank", F.col("key").alias(key), "score")
        found = part if found is None else found.unionByName(part)
    return found
