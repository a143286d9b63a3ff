"""Byte-pair encoding and decoding (operator 4), for vocabulary files with word-end symbols.

``encode`` splits a text into words as the file's normaliser and splitter say and merges each word
by a priority queue of merge ranks over a doubly linked list of symbols. ``decode`` joins vocabulary
strings by spaces, as a file without a decoder asks for. Words repeat, so every Python worker keeps a
table of words already merged, bounded in bytes; a full table is emptied, which costs time and changes
nothing.

Null and empty texts have no ids and decode to the empty text. Texts are encoded whole.
"""

import hashlib
import json
import re
import unicodedata
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import regex

from wattline.llm.common import Known, map_batches, worker_table

# Bytes of the tables of words and of chunks in a Python worker.
WORD_BYTES, CHUNK_BYTES = 80 << 20, 120 << 20
# Ends of words that need no search for the words in a chunk: letters, then one run of these.
PUNCTUATION = ".,;:!?#$%&*|"
# Python's split() also splits at these four, which are no white space for the splitter.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters():
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class Tokenizer:
    """Encoder and decoder of one vocabulary file (JSON of a BPE with byte-level symbols)."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + suffix] for b in range(256)]
        # By left symbol: right symbol -> rank of the pair; by rank: merged symbol.
        pairs = [(vocab[a], vocab[b], vocab[a.removesuffix(suffix) + b]) for a, b in model["merges"]]
        self.ranks = [{} for _ in vocab]
        for rank, (a, b, _) in enumerate(pairs):
            self.ranks[a][b] = rank
        self.merged = [c for _, _, c in pairs]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**vocab, **specials}
        self.strings = [""] * (max(names.values()) + 1)
        for string, number in names.items():
            self.strings[number] = string
        self.decimals = [str(i) for i in range(len(self.strings))]
        self.code = "H" if len(self.strings) <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.splitter = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.special_ids = specials
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.space = regex.compile(r"\p{White_Space}+")
        self.words = Known(lambda w: self.packed(self.merge(w.encode("utf-8", "surrogatepass"))), WORD_BYTES)
        self.chunks = Known(self.chunk_ids, CHUNK_BYTES)

    def merge(self, data):
        """Ids of one word given as bytes.

        The symbols form a doubly linked list. The queue holds the rank and the place of adjacent
        pairs, as one number; an entry whose place is gone, or whose pair has another rank by now,
        is stale and skipped.
        """
        inner, ranks, merged = self.inner, self.ranks, self.merged
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        place = n.bit_length()  # bits of a place in a queue entry
        queue, left = [], symbols[0]
        for i in range(1, n):
            right = symbols[i]
            rank = ranks[left].get(right)
            if rank is not None:
                queue.append(rank << place | i - 1)
            left = right
        if not queue:
            return symbols
        heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        low = (1 << place) - 1
        while queue:
            entry = heappop(queue)
            i = entry & low
            left, j = symbols[i], after[i]
            if left < 0 or j < 0 or ranks[left].get(symbols[j]) != entry >> place:
                continue
            symbols[i] = one = merged[entry >> place]
            symbols[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                rank = ranks[one].get(symbols[k])
                if rank is not None:
                    heappush(queue, rank << place | i)
            h = before[i]
            if h >= 0:
                rank = ranks[symbols[h]].get(one)
                if rank is not None:
                    heappush(queue, rank << place | h)
        return [s for s in symbols if s >= 0]

    def chunk_ids(self, chunk):
        """Ids of a run without white space, as bytes; special tokens in it are looked for first."""
        if self.special and self.special.search(chunk):
            return b"".join(
                self.packed([self.special_ids[part]]) if part in self.special_ids else self.part_ids(part)
                for part in self.special.split(chunk)
            )
        return self.part_ids(chunk)

    def part_ids(self, part):
        # Capital sigma is lowered letter by letter, whatever its place in the word.
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        low = part if part.islower() else part.lower()
        core = low.rstrip(PUNCTUATION)
        if core.isalpha():
            return self.words[low] if core == low else self.words[core] + self.words[low[len(core):]]
        return b"".join(map(self.words.__getitem__, self.splitter.findall(low)))

    def packed(self, ids):
        return array(self.code, ids).tobytes()

    def split(self, text):
        return self.space.split(text) if any(c in text for c in SEPARATORS) else text.split()

    def encode(self, text):
        """Ids of a text as an array; null has none."""
        return np.frombuffer(self.encoded(text), self.dtype)

    def encoded(self, text):
        """Bytes of the ids of a text."""
        return b"".join(map(self.chunks.__getitem__, self.split(text or "")))

    def decode(self, ids):
        """Vocabulary strings of ids, joined by spaces."""
        return " ".join(map(self.strings.__getitem__, ids))


def tokenizer(path):
    """The tokenizer of a file, read once in each Python worker; its tables stay for all its tasks."""
    return worker_table(("bpe", path), lambda: Tokenizer(path))


def encode(df, path, text="text", key="doc_id"):
    """(key, ids): the ids of every row's whole text, as ``array<int>``."""

    def run(batch):
        t = tokenizer(path)
        return {"key": batch["key"], "ids": [t.encode(x).tolist() for x in batch["text"].to_pylist()]}

    kind = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("key"), df[text].alias("text"))
    return map_batches(picked, run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df, path, ids="ids", key="doc_id"):
    """(key, text): the text of every row's ids; null ids decode to the empty text."""

    def run(batch):
        t = tokenizer(path)
        return {"key": batch["key"], "text": [t.decode(x or ()) for x in batch["ids"].to_pylist()]}

    kind = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("key"), df[ids].alias("ids"))
    return map_batches(picked, run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip_digests(df, path, text="text", key="doc_id"):
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every text in one pass, so
    that neither ids nor decoded texts, several times the input, leave the task."""

    def digest(t, x):
        ids = t.encode(x).tolist()
        listed = " ".join(map(t.decimals.__getitem__, ids)).encode()
        decoded = t.decode(ids).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def run(batch):
        t = tokenizer(path)
        counts, ids, decoded = zip(*(digest(t, x) for x in batch["text"].to_pylist()), strict=True)
        return {"key": batch["key"], "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

    kind = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("key"), df[text].alias("text"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(picked, run, schema).withColumnRenamed("key", key)
