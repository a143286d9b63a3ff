"""SimHash near-dedup (operator 6) with pivot distance tables.

A fingerprint has 64 bits; two documents are linked when at most four differ, and components are what
links reach. Equal fingerprints are merged first, so a group of copies is one row from then on.

Candidates: 64 bits in seven blocks; two fingerprints four bits apart agree on three whole blocks at
least, so for each of the 35 choices of three blocks the fingerprints that agree on them form a
bucket. Buckets of one, and buckets with the members of another, go before any rows are brought
together. Inside a bucket, distances to 16 reference fingerprints (pivots) are tabled: by the triangle
inequality a pair whose distances to any pivot differ by more than four cannot be linked, so
members are sorted by the first pivot, only neighbours within four are looked at, the other pivots
discard most of them, and the survivors are verified bit by bit. Links that join nothing new are not
written, so a bucket yields fewer links than members. A large bucket is split into parts, and
every two parts meet in a task of their own.

``drop_near_duplicates`` keeps one document of each component, with the same settings.

Null texts and texts without words have fingerprint zero and are linked like any other. Rows that
repeat a key are one document each; a null key names a component only if there is no other.
"""

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from wattline.llm.common import map_batches, materialize, numbered, text_bytes, unsigned_hex
from wattline.llm.components import components

WORDS, SEED, DIFFERENT = 4, 42, 4
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
SAME = len(BLOCKS) - DIFFERENT
PIVOTS = 16
# Members of a bucket that meet in one task: two parts of this size at most, on average.
PART = 8192
# Shingles hashed at once.
RUN = 1 << 16


def bit_counts(digests):
    """How many of the 64-bit digests (joined, most significant byte first) have each bit set."""
    words = np.frombuffer(digests, np.uint64)
    pad = -len(words) % 255
    lanes = np.concatenate([words, np.zeros(pad, np.uint64)]).reshape(-1, 255)
    counts = np.zeros((8, 8), np.int64)
    one = np.uint64(0x0101010101010101)
    for bit in range(8):
        # Eight counters of a byte each are added up in one number; 255 fit without a carry.
        part = ((lanes >> np.uint64(bit)) & one).sum(axis=1)
        counts[:, 7 - bit] = part.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return counts.reshape(64)


def fingerprint(text, words=WORDS):
    """SimHash of a text's word shingles, as a number of 64 bits."""
    found = text_bytes(text).lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    total = np.zeros(64, np.int64)
    for a in range(0, n, RUN):
        some = found[a : min(n, a + RUN) + words - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        starts = [0, *ends[: -min(words, len(some))].tolist()]
        stops = (ends[min(words, len(some)) - 1 :] - 1).tolist()
        shingles = map(joined.__getitem__, map(slice, starts, stops))
        total += bit_counts(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))))
    bits = np.packbits(2 * total > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(df, text="text", key="doc_id", words=WORDS):
    """(key, fp): fingerprint of every row as a signed long."""

    def run(batch):
        found = [fingerprint(x, words) for x in batch["text"].to_pylist()]
        return {"key": batch["key"], "fp": np.array(found, np.uint64).view(np.int64)}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(df[key].alias("key"), df[text].alias("text")), run, f"key {kind}, fp long")


def masks():
    """For each choice of blocks that must agree, the mask of their bits as a signed number."""
    ends = np.cumsum(BLOCKS).tolist()
    spans = [((1 << w) - 1) << (e - w) for w, e in zip(BLOCKS, ends, strict=True)]
    chosen = [sum(c) for c in combinations(spans, SAME)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def pivots(n=PIVOTS):
    """Reference fingerprints: digests of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def bucket_links(group, fp, different=DIFFERENT):
    """Links inside buckets: ``group`` numbers the bucket of each fingerprint. Returns two arrays of
    positions; the links span what all pairs within ``different`` bits would connect."""
    reference = pivots()
    order = np.lexsort((np.bitwise_count(fp ^ reference[0]), group))
    group, fp = group[order], fp[order]
    table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)
    n = len(fp)
    label = np.arange(n)
    active = np.arange(n)
    left, right = [], []
    for shift in range(1, n):
        active = active[active < n - shift]
        other = active + shift
        near = (group[active] == group[other]) & (table[other, 0] - table[active, 0] <= different)
        active = active[near]
        if not len(active):
            break
        i = active[label[active] != label[active + shift]]
        for p in range(1, PIVOTS):
            i = i[np.abs(table[i, p] - table[i + shift, p]) <= different]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= different]
        if not len(i):
            continue
        root = np.arange(n)

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a in i.tolist():
            x, y = find(label[a]), find(label[a + shift])
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(a)
                right.append(a + shift)
        while not np.array_equal(root, up := root[root]):
            root = up
        label = root[label]
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def link_sorted(batches, different=DIFFERENT):
    """Links of rows (bucket columns ..., fp) that come with equal buckets next to each other."""

    def links(columns):
        keys, fp = columns[:-1], columns[-1].view(np.uint64)
        change = np.zeros(len(fp), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        a, b = bucket_links(np.cumsum(change), fp, different)
        fp = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])

    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        same = np.ones(len(columns[0]), bool)
        for k in columns[:-1]:
            same &= k == k[-1]
        begin = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [c[begin:] for c in columns]
        if begin:
            yield links([c[:begin] for c in columns])
    if rest is not None:
        yield links(rest)


def links(distinct):
    """(u, v): links between the distinct fingerprints in column ``fp``, enough to connect all that
    any link within four bits connects."""
    keys = distinct.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in masks()])).alias("choice", "bits"))
    buckets = keys.groupBy("choice", "bits").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("sign"),
        F.min("fp").alias("least"), F.max("fp").alias("most"),
    ).where("n > 1").dropDuplicates(["n", "sign", "least", "most"]).select("choice", "bits", "n")
    buckets = materialize(buckets, "buckets")
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("fp", "choice"), parts).cast("int")
    members = keys.join(buckets, ["choice", "bits"]).select("choice", "bits", "fp", own.alias("own"), parts.alias("parts"))
    met = members.select("choice", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    bucket = ["choice", "bits", "low", "high"]
    return met.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(link_sorted, "u long, v long")


def near_duplicates(df, text="text", key="doc_id", words=WORDS):
    """(key, fingerprint, component_id): one row for every row of the table."""
    rows = materialize(fingerprints(df, text, key, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = materialize(components(materialize(links(distinct), "links")), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = materialize(rooted.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        F.col("key").alias(key), unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df, text="text", key="doc_id", words=WORDS):
    """The rows that stay, with all their columns: of each component of ``near_duplicates`` the one with
    the smallest key (of several with that key one, a null key only if there is no other)."""
    copy, row = numbered(df)
    found = near_duplicates(copy, text, row, words).select(F.col(row).alias("row"), "component_id")
    keyed = copy.select(copy[row].alias("row"), copy[key].alias("key")).join(found, "row")
    keyed = materialize(keyed, "keyed")
    # Written, so that its size is known before it meets the rows; groups of one need no look.
    stays = keyed.groupBy("component_id").agg(
        F.coalesce(F.min_by("row", "key"), F.min("row")).alias("stays"), F.count(F.lit(1)).alias("n"))
    stays = materialize(stays.where("n > 1").select("component_id", "stays"), "stays")
    # The rows that go are the fewer, so Spark can often send them to the texts.
    gone = keyed.join(stays, "component_id").where("row <> stays").select(F.col("row").alias(row))
    return copy.join(materialize(gone, "gone"), row, "left_anti").drop(row)
