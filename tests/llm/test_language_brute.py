"""Language identification against a version in plain Python: one trigram at a time."""

import collections
import zlib

import numpy as np
import pytest

from conftest import SF
from wattline.llm import language_id, registered

SIZE = language_id.SIZE


def vector(code):
    return np.random.default_rng(code).integers(0, 2, SIZE) * 2 - 1


def trigrams(text):
    """Letters in lower case, a gap for each run of others and at both ends."""
    letters = []
    for c in " " + text + " ":
        low = c.lower() if c.isalpha() else " "
        code = 0 if low == " " else ord(low if len(low) == 1 else c)
        if code or not letters or letters[-1]:
            letters.append(code)
    return collections.Counter(zip(letters, letters[1:], letters[2:], strict=False)) if any(letters) else None


def bundle(text, known={}):  # noqa: B006
    grams = trigrams(text or "")
    if not grams:
        return None
    total = np.zeros(SIZE, np.int64)
    for gram, n in grams.items():
        if gram not in known:
            a, b, c = map(vector, gram)
            known[gram] = np.concatenate([a[-2:], a[:-2]]) * np.concatenate([b[-1:], b[:-1]]) * c
        total += n * known[gram]
    return total


def identify(rows):
    """{id: (held out, language, score)}"""
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    vectors = {i: bundle(text) for i, text, _ in rows}
    sums = {}
    for i, _, lang in rows:
        if lang is not None and not held[i] and vectors[i] is not None and (n := np.sqrt(vectors[i] @ vectors[i])):
            sums[lang] = sums.get(lang, 0) + vectors[i] / n
    names = sorted(sums)
    units = [sums[x] / np.sqrt(sums[x] @ sums[x]) for x in names]
    mean = sum(units) / len(units) if len(units) > 1 else np.zeros(SIZE)
    out = {}
    for i, v in vectors.items():
        if v is None or not v.any():
            out[i] = (held[i], "und", 0.0)
            continue
        w = v / np.sqrt(v @ v) - mean
        cosines = [w @ (u - mean) / np.sqrt((w @ w) * ((u - mean) @ (u - mean))) for u in units]
        best = max(range(len(names)), key=cosines.__getitem__)
        out[i] = (held[i], names[best], (1 + cosines[best]) / 2)
    return out


def same(found, want):
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in want.items()}
    for k, (_, _, score) in want.items():
        assert found[k][2] == pytest.approx(score, abs=1e-4)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    found = registered.op3_language_id(spark, SF).collect()
    assert len(found) == len(docs)
    same({r.doc_id: (r.held_out, r.lang_pred, r.score) for r in found}, identify(list(map(tuple, docs))))


def test_odd_texts_equal_brute_force(spark):
    rows = [
        (1, "Ünïcödé straße ÀÉ", "a"), (2, "ǅ ﬁ İstanbul", "b"), (3, "\U00010400\U00010428 abc", "a"), (4, "x", "b"),
        (5, "one--two\t\nthree 4 five", None), (6, "", "a"), (7, None, "b"), (8, "123 !", "a"), (9, "абв где", "c"),
        (10, "the same the same", "a"), (11, "abв", "c"), (12, "日本語 テキスト", "b"),
    ]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    same({r.doc_id: (r.held_out, r.lang_pred, r.score) for r in found}, identify(rows))
