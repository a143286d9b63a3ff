"""Substring dedup (operator 2): word k-mers as edges of a de Bruijn graph, compacted to paths.

An edge is a window of 35 consecutive words of one document; its nodes are the windows of 34 words it
shares with its neighbours. An edge is repeated when its word sequence starts at another place too,
in the same document or another one. Every word that a repeated edge covers is removed.

Edges are not shuffled one by one. As in published de Bruijn compaction, each edge is named by its
least 8-word hash, its anchor, and neighbouring edges with one anchor make a path, about 15 edges
long. Equal edges have equal anchors, so all that can be equal meets under one anchor:

1. an anchor that occurs once has no repeated edge, and its path goes at once;
2. a path whose whole word sequence occurs again is repeated as it is (nonbranching);
3. an anchor under which different paths meet, or one path meets itself, branches: one copy of each
   of its paths is taken apart into edges, which are counted one by one;
4. repeated paths are compacted: where a path is always followed by one other and that one always
   comes after it, a join of the paths with themselves links the two, and chains of such links
   become one path;
5. repeated paths and edges return to the documents by their source coordinates (document, first
   word, number of edges), where they are merged to maximal spans and cut out;
6. at these coordinates the words themselves are read again, and all places of a path must hold the
   same ones.

Which path an edge belongs to depends on the edge's words alone as far as the anchor goes, and a path
may be cut anywhere, so a path's limits decide only what is compared as a whole, never the result.
Words are hashed to 64 bits; two sequences count as equal at first when both their anchors and their
own 64-bit hashes, of different kinds, agree. Equal words always agree, so only a false agreement can go
wrong. It shows in step 6, where a cryptographic digest (BLAKE2b, 128 bits) of the words at each place is
compared within every path; if one path holds different words, all is done again with other word hashes.

Null texts have no words. Texts of fewer than 35 words stay as they are. Rows that repeat key and
text are copies of each other like any other rows. An empty table gives no row.
"""

import hashlib
from functools import partial
from itertools import compress, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.llm.common import Known, map_batches, materialize, text_bytes, worker_table

WINDOW, ANCHOR = 35, 8
# Edges in a path, at most.
LONGEST = 64
# Words handled at once.
PIECE = 1 << 18
# Bytes of the table of word hashes in a Python worker.
HASH_BYTES = 60 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base, n):
    """base ** 0, 1, ..., n - 1, modulo 2 ** 64."""
    known = worker_table("powers", dict)
    have = known.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = known[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(x):
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequences:
    """Hashes of word sequences of a piece of text, given the words' hashes."""

    def __init__(self, words):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def at(self, start, length):
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


def sliding_minimum(x, width):
    """Least of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def seeded(attempt):
    """(name, function): the hash of words, as bytes, in each attempt."""
    return f"word hashes {attempt}", partial(xxhash.xxh3_64_intdigest, seed=attempt)


FIRST = seeded(0)


def word_hashes(words, hashed=FIRST):
    name, function = hashed
    known = worker_table(name, lambda: Known(function, HASH_BYTES))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def pieces_of(texts, hashed=FIRST):
    """(row, first word, word hashes) of each text; long texts come in pieces that share 34 words,
    so that every window is in exactly one piece."""
    for row, text in enumerate(texts):
        words = text_bytes(text).split()
        for a in range(0, max(1, len(words) - WINDOW + 1), PIECE):
            some = words[a : a + PIECE + WINDOW - 1]
            if len(some) >= WINDOW:
                yield row, a, word_hashes(some, hashed)


def gathered(pieces, size=PIECE):
    """Pieces in groups of about ``size`` words."""
    group, n = [], 0
    for piece in pieces:
        group.append(piece)
        n += len(piece[2])
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def paths_in(group):
    """(row, start, edges, anchor, path hash, whether an edge repeats in it) of a group of pieces."""
    lengths = np.array([len(w) for _, _, w in group])
    words = np.concatenate([w for _, _, w in group])
    first = np.cumsum(lengths) - lengths
    sequences = Sequences(words)
    anchors = sliding_minimum(sequences.at(np.arange(len(words) - ANCHOR + 1), ANCHOR), WINDOW - ANCHOR + 1)
    # Windows that lie in one piece.
    counts = lengths - WINDOW + 1
    place = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = anchors[place]
    head = np.ones(len(place), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    run = np.flatnonzero(head)
    inside = np.arange(len(place)) - np.repeat(run, np.diff([*run, len(place)]))
    head |= inside % LONGEST == 0
    start = np.flatnonzero(head)
    edges = np.diff([*start, len(place)])
    path = np.repeat(np.arange(len(start)), edges)
    edge = sequences.at(place, WINDOW)
    again = np.zeros(len(start), bool)
    order = np.argsort(edge, kind="stable")
    twins = np.flatnonzero((edge[order[1:]] == edge[order[:-1]]) & (path[order[1:]] == path[order[:-1]]))
    again[path[order[twins]]] = True
    at = place[start]
    piece = np.searchsorted(first, at, side="right") - 1
    rows = np.array([r for r, _, _ in group])[piece]
    offsets = np.array([a for _, a, _ in group])[piece] + at - first[piece]
    return rows, offsets, edges, anchor[start], sequences.at(at, edges + WINDOW - 1), again


def paths(docs, hashed=FIRST):
    """(anchor, path, k1, k2, start, edges, again) of rows (k1, k2, text): all paths of all texts."""

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column("k1"), batch.column("k2")
            for group in gathered(pieces_of(batch.column("text").to_pylist(), hashed)):
                rows, start, edges, anchor, path, again = paths_in(group)
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64)), k1.take(rows), k2.take(rows),
                     pa.array(start.astype(np.int32)), pa.array(edges.astype(np.int32)), pa.array(again)],
                    names=["anchor", "path", "k1", "k2", "start", "edges", "again"],
                )

    return docs.select("k1", "k2", "text").mapInArrow(
        run, "anchor long, path long, k1 long, k2 long, start int, edges int, again boolean")


def edges_of(docs, wanted, hashed=FIRST):
    """(anchor, edge, k1, k2, start): the single edges of the paths in ``wanted``."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "edges", "anchor")).alias("paths"))

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            every = zip(batch.column("text").to_pylist(), batch.column("paths").to_pylist(), strict=True)
            for row, (text, found) in enumerate(every):
                words = text_bytes(text).split()
                starts = np.array([p["start"] for p in found], np.int64)
                counts = np.array([p["edges"] for p in found], np.int64)
                anchors = np.array([p["anchor"] for p in found], np.int64)
                order = np.argsort(starts, kind="stable")
                starts, counts, anchors = starts[order], counts[order], anchors[order]
                a = 0
                while a < len(starts):
                    # Paths that start within a bounded stretch of the text.
                    b = int(np.searchsorted(starts, starts[a] + PIECE))
                    base, stop = int(starts[a]), int((starts[a:b] + counts[a:b]).max()) + WINDOW - 1
                    sequences = Sequences(word_hashes(words[base:stop], hashed))
                    n = counts[a:b]
                    place = np.repeat(starts[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    edge = sequences.at(place - base, WINDOW).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(anchors[a:b], n)), pa.array(edge),
                         pa.array(np.full(len(place), k1[row])), pa.array(np.full(len(place), k2[row])),
                         pa.array(place.astype(np.int32))],
                        names=["anchor", "edge", "k1", "k2", "start"],
                    )
                    a = b

    return docs.select("k1", "k2", "text").join(lists, ["k1", "k2"]).mapInArrow(
        run, "anchor long, edge long, k1 long, k2 long, start int")


def compacted(spans):
    """(k1, k2, start, edges, path) of compacted paths, from rows of the same form.

    A path is inner when it has one predecessor at all its places, which in turn has it as its
    only successor. Paths at a document's end have none there, so every chain has a head, and every
    place of a compacted path runs from its head on. Rows that repeat key and text stand at the same
    coordinates; their paths stay as they are.
    """
    spans = materialize(spans, "spans")
    inside = Window.partitionBy("k1", "k2").orderBy("start")
    after = F.lead("start").over(inside) == F.col("start") + F.col("edges")
    before = F.lag(F.col("start") + F.col("edges")).over(inside) == F.col("start")
    linked = spans.select(
        "path", F.when(before, F.lag("path").over(inside)).alias("last"),
        F.when(after, F.lead("path").over(inside)).alias("next"))
    nodes = linked.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("last", "next") for k, f in (
            ("n", F.count), ("low", F.min), ("high", F.max))])

    def only(c):
        return F.when((F.col(f"n_{c}") == F.col("n")) & (F.col(f"low_{c}") == F.col(f"high_{c}")), F.col(f"low_{c}"))

    nodes = materialize(nodes.select("path", only("last").alias("last"), only("next").alias("next")), "nodes")
    a, b = nodes.select(F.col("path").alias("last"), F.col("next").alias("path")), nodes.select("path", "last")
    inner = materialize(a.join(b, ["last", "path"]).select("path", F.lit(True).alias("inner")), "inner")
    headed = spans.join(inner, "path", "left").withColumn(
        "chain", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return headed.groupBy("k1", "k2", "chain").agg(
        F.min("start").alias("start"), F.sum("edges").cast("int").alias("edges"),
        F.min_by("path", "start").alias("path"))


def repeated(docs, hashed=FIRST):
    """Written (k1, k2, start, edges, path): repeated edges of rows (k1, k2, text) by their coordinates,
    as compacted paths where whole paths repeat; ``path`` is the hash of a path's head, or of the edge."""
    every = materialize(paths(docs, hashed), "paths")
    # 1. Anchors that occur again, or in which a path meets itself.
    anchors = every.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("anchor")
    some = materialize(every.join(materialize(anchors, "anchors"), "anchor", "left_semi"), "anchored")
    # 2. The distinct paths, each with one place where it occurs.
    distinct = materialize(some.groupBy("anchor", "path").agg(
        F.count(F.lit(1)).alias("n"), F.max("again").alias("again"),
        *[F.first(c).alias(c) for c in ("k1", "k2", "start", "edges")]), "distinct-paths")
    whole = distinct.where("n > 1").select("anchor", "path")
    spans = compacted(some.join(whole, ["anchor", "path"], "left_semi").select("k1", "k2", "start", "edges", "path"))
    spans = spans.select("k1", "k2", "start", "edges", "path")
    # 3. Edges of the paths whose anchor branches.
    branching = distinct.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("anchor")
    wanted = distinct.join(materialize(branching, "branching"), "anchor", "left_semi")
    edges = materialize(edges_of(docs, wanted, hashed), "edges")
    twice = edges.groupBy("anchor", "edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "edge")
    single = edges.join(materialize(twice, "repeated-edges"), ["anchor", "edge"], "left_semi").select(
        "k1", "k2", "start", F.lit(1).alias("edges"), F.col("edge").alias("path"))
    return materialize(spans.unionByName(single), "repeats")


def covered(n, starts, edges, window=WINDOW):
    """Which of ``n`` words lie in a window that starts at ``starts`` or one of ``edges`` - 1 after it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts) + np.asarray(edges) + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def spans_of(mask):
    """(start, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def digests(words, cut):
    """Array of (path, edges, a, b): 128 bits that stand for the very words of each repeated path or edge."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[:-1]]).tolist()
    ends, view = ends.tolist(), memoryview(text)
    found = b"".join(
        hashlib.blake2b(view[begins[c["start"]] : ends[c["start"] + c["edges"] + WINDOW - 2] - 1], digest_size=16).digest()
        for c in cut)
    halves = np.frombuffer(found, np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays(
        [pa.array([c["path"] for c in cut], pa.int64()), pa.array([c["edges"] for c in cut], pa.int32()),
         pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["path", "edges", "a", "b"])


def same_words(cut):
    """Whether all places of each repeated path hold the same words, from the digests in column ``seen``."""
    bounds = [f(c).alias(f"{k}_{c}") for c in ("a", "b") for k, f in (("low", F.min), ("high", F.max))]
    each = cut.select(F.explode("seen").alias("s")).select("s.*").groupBy("path", "edges").agg(*bounds)
    return each.where("low_a <> high_a OR low_b <> high_b").isEmpty()


def remove_repeats(df, text="text", key="doc_id", with_text=True, hashes=seeded):
    """One row for every row of the table: key, n_words, n_removed, kept_sha256 and, if wanted, the
    kept text and the removed spans [start, end) in words. ``hashes`` gives the word hash of each attempt."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(
        df[key].alias("key"), df[text].alias("text"), F.xxhash64(df[text], F.lit(1)).alias("k1"),
        F.xxhash64(df[key], F.lit(2), df[text]).alias("k2"))

    def run(batch):
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "spans": []}
        seen, places = [digests([], [])], [0]
        for x, cut in zip(batch["text"].to_pylist(), batch["cut"].to_pylist(), strict=True):
            words = text_bytes(x).split()
            kept, gone = words, []
            if cut:
                mask = covered(len(words), [c["start"] for c in cut], [c["edges"] for c in cut])
                kept = list(compress(words, (~mask).tolist()))
                gone = spans_of(mask)
                seen.append(digests(words, cut))
            places.append(places[-1] + len(cut or []))
            joined = b" ".join(kept)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            if with_text:
                out["kept"].append(joined.decode("utf-8", "replace"))
                out["spans"].append([{"start": a, "end": b} for a, b in gone])
        return out | {"key": batch["key"], "seen": pa.ListArray.from_arrays(places, pa.concat_arrays(seen))}

    schema = f"key {kind}, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += ", kept string, spans array<struct<start: int, end: int>>"
    for attempt in count():
        lists = repeated(docs, hashes(attempt)).groupBy("k1", "k2").agg(
            F.collect_list(F.struct("start", "edges", "path")).alias("cut"))
        found = docs.join(lists, ["k1", "k2"], "left").select("key", "text", "cut")
        cut = materialize(
            map_batches(found, run, f"{schema}, seen array<struct<path: long, edges: int, a: long, b: long>>"), "cut")
        if same_words(cut):
            return cut.drop("seen").withColumnRenamed("key", key)
