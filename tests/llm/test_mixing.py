"""Mixing sources to target weights: hand-made shares, hot sources and keys, odd rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from wattline.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def texts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def water_level(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing again and again, in source order."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = sum(sizes.values()) * share, {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def check(df, rows):
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    want, taken = water_level(sizes), collections.Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    goals = collections.Counter()
    for s, goal in want.items():
        goals[sizes[s], round(goal, 6)] += goal
    assert set(goals) == set(taken)
    for k, goal in goals.items():
        assert abs(taken[k] - goal) <= mixing.QUANTUM * len(sizes)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))


def test_targets_are_met_and_the_budget_is_used_up(spark):
    rows = [(i, "w " * (1 + i * 37 % 211), f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, "w " * 900, "s0") for i in range(40)] + [(2000, "long " * 30_000, "s3")]
    check(texts(spark, rows), rows)


def test_odd_rows(spark):
    rows = [(1, "a b c", None), (None, None, "x"), (None, "a\x0bb", "x"), (2, "", "y"), (2, " \t\n ", "y"),
            (3, "a b\u2003c d", "z"), (3, "a b\u2003c d", "z"), (4, "é" * 50, "é"), (5, "one", "\U0001f600")]
    df = texts(spark, rows).withColumns({c: F.lit("x") for c in ("key", "row", "size", "place", "part", "target", "start")})
    check(df, rows)
    assert mixing.mix(df.where("false")).collect() == []
    empty = mixing.mix(df.where("doc_id = 2")).collect()
    assert [(r["size"], r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_a_third_of_the_rows_share_one_key(spark):
    rows = [(7, "a b c d e", "s0")] * 300 + [(i, "x " * (i % 20), f"s{i % 3}") for i in range(600)]
    check(texts(spark, rows), rows)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = [(i, "w " * (i * 13 % 97), f"s{i % 5}") for i in range(300)]
    a = mixing.mix(texts(spark, rows).repartition(1)).collect()
    b = mixing.mix(texts(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("weights, share", [((1,), 1.0), ((5, 1), 0.5)])
def test_the_mix_in_its_order(spark, weights, share):
    rows = [(i, "w " * (5 + i % 30), "ab"[i % 4 == 0]) for i in range(200)]
    df = texts(spark, rows)
    entries = sorted(mixing.mixed_texts(df, weights, share).collect())
    at = 0
    for e in entries:
        assert e.position == at and 0 <= e.first_word and e.first_word + e.words <= 5 + e.doc_id % 30
        at += e.words
    assert at == int(share * sum(5 + i % 30 for i in range(200)))
    taken = collections.Counter()
    for e in entries:
        taken[e.doc_id] += e.words
    assert {r.doc_id: r.taken for r in mixing.mix(df, weights, share).collect() if r.taken} == dict(taken)
    # At any point, each source is served in proportion to its target, up to a document.
    goal = {r.doc_id: r.target for r in mixing.mix(df, weights, share).collect()}
    served = collections.Counter()
    for e in entries[: len(entries) // 2]:
        served["ab"[e.doc_id % 4 == 0]] += e.words
    parts = [served[s] / goal[k] for s, k in (("a", 1), ("b", 0))]
    assert abs(parts[0] - parts[1]) * min(goal.values()) <= 40


def test_words_are_counted_without_lists(spark):
    rows = [(i, t, "s") for i, t in enumerate(["", " ", "a", " a", "a ", "\ta\r\nb\x0c", "a\xa0b c", "xx", "x x", None])]
    got = {r.doc_id: r.n for r in texts(spark, rows).select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 1, 8: 2, 9: 0}
