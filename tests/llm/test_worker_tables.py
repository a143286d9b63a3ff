"""Tables of a Python worker: they outlive a task, are bounded in bytes, and change no result."""

import os

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from wattline.llm import bpe, language_id, substring_dedup
from wattline.llm.common import Known, worker_table

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_later_task_of_a_worker_finds_the_tables_filled(spark):
    """Other tests may have filled the tables of a worker before, so these two words are looked for."""

    def run(batches):
        t = bpe.tokenizer(PATH)
        before = len(t.words)
        name, function = substring_dedup.FIRST
        table = worker_table(name, lambda: Known(function, substring_dedup.HASH_BYTES))
        hashes = sum(w in table for w in (b"some", b"words"))
        for _ in batches:
            t.encode("some words to be kept")
            substring_dedup.word_hashes([b"some", b"words"])
            language_id.bundle("some words")
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([before]), pa.array([hashes])], names=["pid", "n", "h"])

    def once():
        return spark.range(0, 8, 1, 8).mapInArrow(run, "pid long, n long, h long").collect()

    first = {r.pid for r in once()}
    again = [r for r in once() if r.pid in first]
    assert again and all(r.n > 0 and r.h == 2 for r in again)


def test_tables_are_bounded_in_bytes_and_keep_no_long_string():
    known = Known(str.upper, 3000)
    for i in range(500):
        assert known[f"word{i}"] == f"WORD{i}" and known.bytes <= 3000
    long = "x" * 10_000
    assert known[long] == long.upper() and long not in known


def test_a_full_table_changes_no_id(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 2000)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 2000)
    small, library = bpe.Tokenizer(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"wörd{i % 70}, {'base64' * i}" for i in range(120))
    assert small.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
