"""Every registered query of the subpackage on the smallest tables: against its SQL, or else against
the libraries and brute force."""

import array
import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from conftest import SF
from wattline.llm import registered

QUERIES, SQL = contract.queries(), contract.oracle_sql()
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(db):
    return db.sql("SELECT doc_id, text, lang FROM documents").fetchall()


def test_all_are_registered():
    numbers = {int(n.split("_")[0][2:]) for n in registered.QUERIES}
    assert numbers == set(range(1, 14)) and set(registered.QUERIES) | {"pipeline"} <= set(QUERIES)
    assert set(registered.SQL) <= set(registered.QUERIES)


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_equals_sql(spark, db, name):
    found, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    names, columns = sorted(found.columns), want.columns
    assert names == sorted(columns)
    place = [columns.index(n) for n in names]
    assert sorted(repr(tuple(r)) for r in found.select(*names).collect()) == sorted(
        repr(tuple(r[i] for i in place)) for r in want.fetchall())


def test_bpe_equals_the_library(spark, docs, library):
    found = {r.doc_id: r for r in QUERIES["op4_bpe"](spark, SF).collect()}
    assert len(found) == len(docs)
    for key, text, _ in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = found[key]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def check_pieces(rows, ids_of):
    """Every id in one piece, sequences without gaps and full but for the last."""
    sequences, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = ids_of[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(ids_of[r.doc_id])
        assert zlib.crc32(array.array("I", ids).tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        places[r.doc_id].append((r.start, r.length))
    filled = {}
    for parts in (sequences, places):
        for key, found in parts.items():
            at = 0
            for start, n in sorted(found):
                assert start == at and n > 0
                at += n
            filled[parts is sequences, key] = at
    assert {k: filled[False, k] for k in ids_of} == {k: len(v) for k, v in ids_of.items()}
    last = max(sequences, default=None)
    assert all(filled[True, s] == 2048 for s in sequences if s != last)


def test_packing(spark, docs, library):
    ids = {k: library.encode(t, add_special_tokens=False).ids + [1] for k, t, _ in docs}
    check_pieces(QUERIES["op5_packing"](spark, SF).collect(), ids)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    """{key: smallest key reachable} of {key: fingerprint}."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    label = np.arange(len(keys))
    while True:
        new = np.array([label[np.bitwise_count(values ^ v) <= bits].min() for v in values])
        if (new == label).all():
            return {k: keys[i] for k, i in zip(keys, label, strict=True)}
        label = new


def test_simhash_equals_brute_force(spark, docs):
    prints = {k: brute_fingerprint(t) for k, t, _ in docs}
    found = QUERIES["op6_simhash"](spark, SF).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == brute_components(prints)


def test_language_id_on_held_out_rows(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    held = [(lang, found[k].lang_pred) for k, _, lang in docs if found[k].held_out]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95


def normal(text):
    return " ".join(("x" + text + "x").split())[1:-1] if text else ""


def test_pipeline_equals_brute_force(spark, docs, library, db):
    """Stage by stage: what stays is known from brute force, masked texts from the SQL's spans."""
    found = QUERIES["pipeline"](spark, SF).collect()
    read = spark.read.parquet(f"{SF}/documents.parquet")
    stay = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, read, SF).collect()}
    texts = {k: t for k, t, _ in docs}
    assert stay == {k for k, t in texts.items() if any(c.isalpha() for c in t)}
    first = {}
    for k in sorted(stay):
        first.setdefault(normal(texts[k]), k)
    prints = {k: brute_fingerprint(texts[k]) for k in first.values()}
    kept = {k for k, root in brute_components(prints).items() if k == root}
    spans = {r[0]: r[1] for r in db.sql(f"SELECT doc_id, spans FROM ({SQL['op8_secret_scan']})").fetchall()}
    ids = {}
    for k in kept:
        masked, at = "", 0
        for span in filter(None, spans[k].split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                masked += texts[k][at : int(a)] + "[SECRET]"
            at = max(at, int(b))
        ids[k] = library.encode(masked + texts[k][at:], add_special_tokens=False).ids + [1]
    check_pieces(found, ids)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs.limit(20), SF)
        assert found.schema.simpleString() == docs.schema.simpleString(), name


def test_whitening_equals_dense_eigenvectors(spark, db):
    rows = db.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = np.floor(np.array([v for _, v in rows], np.float64) * 256)
    fits = np.unique(x, axis=0)
    centred = fits - fits.mean(axis=0)
    e, p = np.linalg.eigh(centred.T @ centred / len(fits))
    e, p = e[::-1][:4], p[:, ::-1][:, :4]
    want = {k: np.abs((row - fits.mean(axis=0)) @ p / np.sqrt(e)) for (k, _), row in zip(rows, x, strict=True)}
    found = QUERIES["op13_whitening"](spark, SF).collect()
    assert len(found) == 4 * len(rows) and max(r.identity_error for r in found) < 1e-8
    for r in found:
        assert r.n == len(fits) and abs(abs(r.whitened) - want[r.vec_id][r.component - 1]) < 1e-9
