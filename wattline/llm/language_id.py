"""Language identification (operator 3) by hyperdimensional profiles.

Every letter has a fixed random vector of -1 and 1, drawn from its code point; a gap between words has
one too. A trigram is bound from its letters: the vectors of the first, rotated by two places, of the
second, rotated by one, and of the third are multiplied. A text is the bundle (sum) of its trigrams, a
language the bundle of its texts, each scaled to one length. The mean of the languages is what all
share and is taken out of prototypes and texts. The language whose prototype has the highest cosine
with the text is predicted; its score is (1 + cosine) / 2.

That score compares languages, so it is high for the best one whatever the text. Whether a text is in
any of them is told by its support: its mean product, over its trigrams, with a language's prototype
before the mean is taken out. Its mean does not depend on the text's length. Prediction can give the share of
that support in what the language's own training rows have on average, each with the other rows; a
language of one row has no such average and sets no bar. What chance can take from a short text's support
is added to it first.

Prototypes are whole-number sums over all training rows, so they do not depend on the order of adding
up. They are one vector for each language; a table with more than ``most`` languages is refused.

Null texts and texts without a letter are ``und`` with score 0, as is every text when there is no
training row. Texts are read whole. Ties go to the language that sorts first. An empty table gives no
row.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wattline.llm.common import map_batches, worker_table

UNKNOWN = "und"
SIZE = 512  # components of a vector
SCALE = 1 << 16  # length of a training text's vector, in whole numbers
MOST = 1000
CHANCE = 1.5  # deviations of a chance product, which has 1 for a trigram, that a text's support is given
KEPT_TRIGRAMS = 30_000
PIECE = 1 << 20  # letters handled at once
GAP = 0


class Tables:
    """Vectors of letters and bound vectors of trigrams (their places in ``rows``), in a Python worker."""

    def __init__(self):
        self.low, self.letters, self.trigrams = is_letter_table(), {}, {}
        self.rows = np.empty((KEPT_TRIGRAMS, SIZE), np.float32)


def tables():
    return worker_table("language vectors", Tables)


def is_letter_table():
    """For the first 2 ** 16 code points: the lower-case letter, or the gap."""
    table = np.zeros(1 << 16, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letters_of(text):
    """Code points in lower case, with one gap for every run of other characters and at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = tables().low[np.minimum(codes, (1 << 16) - 1)]
    for i in np.flatnonzero(codes >= 1 << 16).tolist():
        c = chr(codes[i])
        low[i] = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else GAP
    low = np.concatenate([[GAP], low, [GAP]]).astype(np.uint64)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != GAP) | (low[:-1] != GAP)
    return low[keep]


def letter(code):
    known = tables().letters
    if code not in known:
        if len(known) >= KEPT_TRIGRAMS:
            known.clear()
        known[code] = np.random.default_rng(code).integers(0, 2, SIZE).astype(np.float32) * 2 - 1
    return known[code]


def trigram_rows(codes):
    """Bound vectors of up to ``KEPT_TRIGRAMS`` trigrams; their table is emptied when it is full."""
    t = tables()
    new = [c for c in codes if c not in t.trigrams]
    if new:
        if len(t.trigrams) + len(new) > KEPT_TRIGRAMS:
            t.trigrams.clear()
            new = codes
        for c in new:
            a, b, d = c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF
            t.trigrams[c] = at = len(t.trigrams)
            t.rows[at] = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(d)
    return t.rows[[t.trigrams[c] for c in codes]]


def bundle(text):
    """Vector of a text, or None without a letter."""
    return bundled(text)[0]


def bundled(text):
    """(vector of a text, number of its trigrams); the vector is None without a letter."""
    if not text:
        return None, 0
    total, n = np.zeros(SIZE), 0
    for a in range(0, len(text), PIECE):
        # Pieces share two letters, so that no trigram is lost between them.
        low = letters_of(text[max(0, a - 2) : a + PIECE])
        if len(low) < 3:
            continue
        n += len(low) - 2
        grams, counts = np.unique(low[:-2] << np.uint64(42) | low[1:-1] << np.uint64(21) | low[2:], return_counts=True)
        for b in range(0, len(grams), KEPT_TRIGRAMS):
            rows = trigram_rows(grams[b : b + KEPT_TRIGRAMS].tolist())
            total += counts[b : b + KEPT_TRIGRAMS].astype(np.float32) @ rows
    return (total, n) if n else (None, 0)


def prototypes(df, text="text", lang="lang", most=MOST):
    """{language: vector}: bundles of all rows with a language."""
    return profiles(df, text, lang, most)[0]


def profiles(df, text="text", lang="lang", most=MOST):
    """({language: vector}, {language: mean support of its rows}). For each language one sum for each
    component of two vectors, and two more, reach the driver."""
    size = 2 * SIZE + 2

    def run(batches):
        sums = {}
        for batch in batches:
            for x, y in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                v, grams = bundled(x)
                if v is not None and (n := np.linalg.norm(v)):
                    v = np.rint(np.concatenate([v / n, v / grams, [n / grams, 1]]) * SCALE).astype(np.int64)
                    sums[y] = sums[y] + v if y in sums else v
        for y, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([y] * size), pa.array(range(size), pa.int32()), pa.array(v)], names=["lang", "at", "value"])

    rows = df.where(df[lang].isNotNull()).select(df[text].alias("text"), df[lang].alias("lang"))
    sums = rows.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = sums.limit(most * size + 1).collect()
    if len(found) > most * size:
        raise ValueError(f"more than {most} languages")
    out = {}
    for r in found:
        out.setdefault(r["lang"], np.zeros(size))[r["at"]] = r["value"]
    return {y: v[:SIZE] for y, v in out.items()}, {y: support(v) for y, v in out.items()}


def support(sums):
    """Mean support of a language's rows, each with the bundle of the others; 0 for a single row."""
    bundles, means, (own, n) = sums[:SIZE], sums[SIZE : 2 * SIZE], sums[2 * SIZE :] / SCALE
    if n < 2:
        return 0.0
    with_others = bundles @ means / SCALE**2 - own
    # What is left without one row is on average this long.
    length = np.sqrt(max((bundles @ bundles / SCALE**2) * (1 - 2 / n) + 1, 1e-12))
    return max(with_others / (n * length), 0.0)


def predict(df, known, text="text", lang_pred="lang_pred", score="score", supports=None, share="share"):
    """All columns of ``df`` without the text, and the columns ``lang_pred`` and ``score``. Only the
    text is looked at; ``known`` comes from ``prototypes``. With ``supports`` from ``profiles`` there
    is a column ``share`` too: the largest share of a language's support that the text has, null
    where the predicted language sets no bar."""
    names = sorted(known)
    if names:
        unit = np.array([known[n] / np.linalg.norm(known[n]) for n in names])
        mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(SIZE)
        centred = unit - mean
        centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
        bar = np.array([(supports or {}).get(n, 0.0) for n in names])

    def guess(x):
        v, grams = bundled(x) if names else (None, 0)
        if v is None or not (n := np.linalg.norm(v)):
            return UNKNOWN, 0.0, 0.0
        w = v / n - mean
        cosines = centred @ w / max(np.linalg.norm(w), 1e-12)
        best = int(np.argmax(cosines))
        part = float(np.max(((unit @ v) / grams + CHANCE / np.sqrt(grams))[bar > 0] / bar[bar > 0])) if bar[best] > 0 else None
        return names[best], float(np.clip((1 + cosines[best]) / 2, 0, 1)), part

    others = [f for f in df.schema if f.name != text]
    added = [StructField(lang_pred, StringType()), StructField(score, DoubleType())]
    if supports is not None:
        added.append(StructField(share, DoubleType()))

    def run(batch):
        found = [guess(x) for x in batch[text].to_pylist()]
        return {f.name: batch[f.name] for f in others} | {f.name: [x[i] for x in found] for i, f in enumerate(added)}

    return map_batches(df, run, StructType([*others, *added]))


def is_held_out(key):
    """Whether a row is kept from training: crc32 of the key as text leaves 2 by 4; a null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df, text="text", lang="lang", key="doc_id"):
    """(key, held_out, lang_pred, score): one row for every row, learned from rows not held out."""
    known = prototypes(df.where(~is_held_out(df[key])), text, lang)
    rows = df.select(df[key], is_held_out(df[key]).alias("held_out"), df[text].alias("text"))
    return predict(rows, known, "text")
