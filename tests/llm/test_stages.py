"""Stages of the corpus pipeline on planted cases."""

import base64
import random

import corpus_pipeline
from conftest import SF
from test_queries import brute_components, brute_fingerprint
from wattline.llm import registered, secret_scan, url_rules


def gibberish(seed=3):
    r = random.Random(seed)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) + "q" for n in (200, 400, 5000)]
    encoded = [base64.b64encode(r.randbytes(n)).decode() for n in (200, 1000)]
    markup = ['<div class="row"><span id=\'x1\'>&nbsp;</span><br/></div><script>b=function(){return 0}</script>' * 5]
    unlearned = ["Все люди рождаются свободными и равными в своем достоинстве и правах.",
                 "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler."]
    return noise + encoded + markup + unlearned


def test_language_stage_drops_gibberish_and_keeps_texts_of_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Labelled, as a table's own labels are not to be trusted either, and not.
    planted = spark.createDataFrame(
        [(10**6 + i, t, lang) for i, (t, lang) in enumerate((t, x) for t in gibberish() for x in ("en", None))],
        "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(planted)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, SF).collect()}
    clean = {r.doc_id: r.lang for r in docs.collect() if any(c.isalpha() for c in r.text)}
    assert kept == set(clean) and len(set(clean.values())) == 4


def test_language_stage_keeps_short_clean_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    short = [(10**6, "Por el para ieí.", None), (10**6 + 1, "Hean trash be it as. scum", None)]
    kept = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(short, docs.schema)), SF)
    assert kept.where(f"doc_id >= {10**6}").count() == 2


def words(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}


def test_near_dedup_keeps_one_document_of_each_group(spark):
    r = random.Random(7)
    bodies = []
    for n in (60, 400, 1500):
        for new in (0, 1, 2, n // 10, n // 3):
            base = words(r, n)
            bodies += [base, words(r, new) + base[new:]]
    texts = [" ".join(x) for x in bodies] + ["", None, " \t"]
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    groups = brute_components(prints)
    assert 3 < len(set(groups.values())) < len(texts) - 5
    assert kept_of(spark, texts) == set(groups.values())


def test_near_dedup_of_one_group_of_thousands(spark):
    r = random.Random(8)
    base = words(r, 600)
    texts = [" ".join(words(r, 400))] + [" ".join([*base, f"x{i % 40}"]) for i in range(4000)]
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts[:41])}
    kept = kept_of(spark, texts)
    assert kept == set(brute_components(prints).values())


def test_capitals_end_the_tokens_of_a_rule(spark):
    urls = ["http://a.org/Xspam-farm", "http://a.org/spam-farmX", "http://a.org/spam-farm", "http://a.org/xspam-farm",
            "http://a.org/spam-farmx", "http://a.org/Spam-farm", "http://spam.org/", "http://farm.org/farm"]
    rules = [url_rules.pattern_rule(*p) for p in registered.PATTERNS]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for more in ([], ["http://spam.org/"] * 9, ["http://farm.org/"] * 9):  # filed under either token
        both = pages.unionByName(spark.createDataFrame([(100 + i, u) for i, u in enumerate(more)], pages.schema))
        found = {r.page_id: r.verdict for r in url_rules.judge_urls(both, rules).collect()}
        assert [found[i] for i in range(8)] == ["block"] * 3 + ["allow"] * 5


def test_the_github_rule_has_a_trigram_query():
    rule = next(r for r in secret_scan.RULES if r.kind == "github")
    assert secret_scan.trigram_query(rule.pattern) == [[f"gh{c}", f"h{c}_"] for c in "oprsu"]
