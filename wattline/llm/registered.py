"""The registered queries of this subpackage, each over its whole table, and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from wattline.llm import (
    bpe, exact_dedup, language_id, lexical_search, mixing, packing, revisit, secret_scan, simhash,
    substring_dedup, url_rules, vector_search, whitening,
)
from wattline.llm.common import prepare, read_table

VOCABULARY = "word_bpe_49k.json"


# Host and path rules, and rules of the method's own for hosts and paths that name themselves.
SITES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
]
PATTERNS = [
    (r"(?<![0-9a-z])spam-farm(?![0-9a-z])", "block", ("spam", "farm")),
    (r"(?i:(?<![0-9a-z])(?:ads?|banner)s?/)", "block", ()),
]

# Captures that pages stand for. Five pages in a row are versions of the first one's URL, each captured in
# full 50 minutes after the one before, the last two at one time; each is asked for again 30 minutes before
# it (validators of a version to come) and 20 minutes after it. One in nine asks without validators.
CAPTURES = """
    SELECT id, url, time, CASE k WHEN 0 THEN 200 ELSE 304 END AS status,
        CASE k WHEN 0 THEN map('Content-Type', 'text/html', 'ETag', concat('"', tag, '"'),
                'Last-Modified', concat('v', first % 7), 'Cache-Control', concat('max-age=', page_id % 100))
            ELSE map('Content-Length', '0', 'Cache-Control', 'no-cache',
                'ETag', CASE WHEN page_id % 9 = 5 THEN '' WHEN page_id % 4 = 0 THEN concat('"', tag, '"')
                    WHEN page_id % 4 = 1 THEN concat('W/"', tag, '"') WHEN page_id % 4 = 2 THEN '"other"' ELSE '' END,
                'Last-Modified', CASE WHEN page_id % 4 = 3 AND page_id % 9 <> 5 THEN concat('v', first % 7) ELSE '' END)
            END AS headers,
        CASE k WHEN 0 THEN digest END AS digest
    FROM (
        SELECT p.page_id, p.first, k, p.tag, p.digest, p.page_id * 3 + k AS id,
            concat(coalesce(l.url, p.url), CASE k WHEN 1 THEN '#again' ELSE '' END) AS url,
            timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(p.first * 7919 % 20000
                + 50 * least(p.page_id % 5, 3) + CASE k WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE -30 END AS INT), 0) AS time
        FROM (SELECT page_id, page_id - page_id % 5 AS first, url, md5(html) AS tag, sha2(html, 256) AS digest
              FROM {pages}) p
        LEFT JOIN (SELECT page_id, url FROM {pages}) l ON l.page_id = p.first
        LATERAL VIEW explode(array(0, 1, 2)) AS k)"""


def documents(spark, folder, *columns):
    return read_table(prepare(spark), folder, "documents", *columns)


def op1_url_rules(spark, folder):
    pages = read_table(prepare(spark), folder, "pages", "page_id", "url")
    rules = [url_rules.site_rule(*s) for s in SITES] + [url_rules.pattern_rule(*p) for p in PATTERNS]
    return url_rules.judge_urls(pages, rules)


def op2_substring_dedup(spark, folder):
    return substring_dedup.remove_repeats(documents(spark, folder, "doc_id", "text"), with_text=False)


def op3_language_id(spark, folder):
    return language_id.identify(documents(spark, folder, "doc_id", "text", "lang"))


def op4_bpe(spark, folder):
    return bpe.round_trip_digests(documents(spark, folder, "doc_id", "text"), public_tokenizers.path(VOCABULARY))


def op5_packing(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), with_ids=False)


def op6_simhash(spark, folder):
    return simhash.near_duplicates(documents(spark, folder, "doc_id", "text"))


def op7_vector_search(spark, folder):
    vectors = read_table(prepare(spark, 64), folder, "embeddings", "vec_id", "embedding")
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op8_secret_scan(spark, folder):
    return secret_scan.secret_report(documents(spark, folder, "doc_id", "text"))


def op9_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(documents(spark, folder, "doc_id", "text"))


def op10_revisit(spark, folder):
    pages = read_table(spark, folder, "pages", "page_id", "url", "html")
    found = revisit.resolve_revisits(spark.sql(CAPTURES, pages=pages))
    return found.select(
        "id", "canonical", "state", "source_id", "digest",
        F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(
            e["key"], F.lit("="), e["value"])), "|").alias("headers"))


def op11_lexical_search(spark, folder):
    items = read_table(spark, folder, "benchmark", "item_id", "text")
    return lexical_search.search(documents(spark, folder, "doc_id", "text"), items)


def op12_mixing(spark, folder):
    return mixing.mix(documents(spark, folder, "doc_id", "text", "source"))


def op13_whitening(spark, folder):
    return whitening.whiten(read_table(prepare(spark), folder, "embeddings", "vec_id", "embedding"))


QUERIES = {
    "op1_url_rules": op1_url_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_vector_search": op7_vector_search,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_revisit": op10_revisit,
    "op11_lexical_search": op11_lexical_search,
    "op12_mixing": op12_mixing,
    "op13_whitening": op13_whitening,
}


def either_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
# Kind, pattern, group and least length, written out for DuckDB's expressions.
KINDS = [
    ("assign", f"""({KEYWORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "(?:xoxb|xoxp|xoxa|xoxr|xoxs)-[0-9A-Za-z-]{10,}", 0, 1),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]


def kind_sql(place, kind, pattern, group, least):
    """Rows (doc, kind, start, end) of one kind: matches and the text between them, added up."""
    return f"""
        SELECT n, {place} AS place, '{kind}' AS kind, a + before AS start, a + before + length(m) AS stop
        FROM (SELECT n, m, v, length(s) AS before,
                     coalesce(sum(length(s) + length(m)) OVER (PARTITION BY n ORDER BY i
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
              FROM (SELECT n, unnest(ms) AS m, unnest(vs) AS v, unnest(ss[1:len(ms)]) AS s,
                           unnest(range(len(ms))) AS i
                    FROM (SELECT n, regexp_extract_all(t, '{pattern}', 0) AS ms,
                                 regexp_extract_all(t, '{pattern}', {group}) AS vs,
                                 string_split_regex(t, '{pattern}') AS ss FROM d)))
        WHERE length(v) >= {least}"""


SQL = {
    "op1_url_rules": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN translate(
                       regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN contains(url, '://') THEN
                       regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        rules(rule, h, p, verdict) AS (VALUES ('com/', 'com', '/', 'allow'),
            ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
            ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        fits AS (
            SELECT p.*, (SELECT max_by(r.rule, length(r.rule)) FROM rules r WHERE starts_with(p.path, r.p)
                         AND (p.host = r.h OR ends_with(p.host, '.' || r.h))) AS rule FROM parts p)
        SELECT page_id, host, path, f.rule,
               CASE WHEN f.rule IS NOT NULL THEN r.verdict
                    WHEN regexp_matches(host || path, '(^|[^0-9a-z])spam-farm([^0-9a-z]|$)')
                      OR regexp_matches(lower(host || path), '(^|[^0-9a-z])(ads?|banner)s?/') THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM fits f LEFT JOIN rules r ON r.rule = f.rule""",
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS n, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT n, i, array_to_string(w[i:i + 34], ' ') AS s
            FROM (SELECT n, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        again AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1),
        words AS (SELECT n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        marked AS (
            SELECT words.n, words.i, word, max(again.i) OVER (
                       PARTITION BY words.n ORDER BY words.i ROWS UNBOUNDED PRECEDING) AS last
            FROM words LEFT JOIN again USING (n, i)),
        kept AS (
            SELECT n, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS c FROM marked
            WHERE last IS NULL OR i - last >= 35 GROUP BY n)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(c, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (n)""",
    "op7_vector_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(
                       CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
        SELECT * FROM (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
                   vec_id, score FROM scored) WHERE rank <= 5""",
    "op8_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(kind_sql(i, *k) for i, k in enumerate(KINDS))}),
        listed AS (
            SELECT n, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
                   count(*) FILTER (place = 2) AS n_hex,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
            FROM found GROUP BY n)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN listed USING (n)""",
    "op9_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
              FROM documents)""",
    "op10_revisit": r"""
        WITH captures AS (
            SELECT p.page_id * 3 + k AS id, coalesce(l.url, p.url) || CASE k WHEN 1 THEN '#again' ELSE '' END AS url,
                   TIMESTAMP '2024-01-01' + to_minutes(CAST((p.page_id - p.page_id % 5) * 7919 % 20000
                       + 50 * least(p.page_id % 5, 3) + CASE k WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE -30 END AS INT)) AS time,
                   k = 0 AS stored, '"' || md5(p.html) || '"' AS own_tag, sha256(p.html) AS sha, p.page_id,
                   p.page_id - p.page_id % 5 AS first, p.page_id % 9 = 5 AS bare
            FROM pages p LEFT JOIN pages l ON l.page_id = p.page_id - p.page_id % 5, (VALUES (0), (1), (2)) AS t(k)),
        cut AS (
            SELECT *, regexp_replace(regexp_extract(url, '(?s)://(.*)$', 1), '(?s)#.*$', '') AS rest FROM captures),
        named AS (
            SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'),
                       lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS args,
                   regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)),
                       '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
                   regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') AS path FROM cut),
        keyed AS (
            SELECT *, CASE WHEN contains(url, '://') THEN host || path || CASE WHEN len(args) > 0
                       THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical,
                   CASE WHEN stored THEN own_tag WHEN bare THEN NULL WHEN page_id % 4 IN (0, 1) THEN own_tag
                        WHEN page_id % 4 = 2 THEN '"other"' END AS tag,
                   CASE WHEN stored OR (page_id % 4 = 3 AND NOT bare) THEN 'v' || first % 7 END AS modified FROM named),
        paired AS (
            SELECT k.*, (SELECT max_by(b.id, (b.time, b.id)) FROM keyed b WHERE b.stored AND b.canonical = k.canonical
                         AND b.time < k.time) AS base FROM keyed k),
        judged AS (
            SELECT p.*, b.tag AS base_tag, b.modified AS base_modified, b.sha AS base_sha, b.page_id AS base_page,
                   CASE WHEN p.stored THEN 'response' WHEN b.id IS NULL THEN 'orphan' WHEN p.bare THEN 'unverified'
                        WHEN p.tag IS NOT NULL THEN CASE WHEN p.tag = b.tag THEN 'resolved' ELSE 'mismatch' END
                        WHEN p.modified = b.modified THEN 'resolved' ELSE 'mismatch' END AS state
            FROM paired p LEFT JOIN keyed b ON b.id = p.base)
        SELECT id, canonical, state, CASE WHEN state = 'resolved' THEN base END AS source_id,
               CASE WHEN stored THEN sha WHEN state = 'resolved' THEN base_sha END AS digest,
               CASE WHEN stored THEN 'cache-control=max-age=' || page_id % 100 || '|content-type=text/html|etag=' || tag
                        || '|last-modified=' || modified
                    WHEN state = 'resolved' THEN 'cache-control=no-cache|content-type=text/html|etag='
                        || CASE page_id % 4 WHEN 1 THEN 'W/' ELSE '' END || CASE WHEN page_id % 4 = 3 THEN '' ELSE tag END
                        || '|last-modified=' || CASE WHEN page_id % 4 = 3 THEN modified ELSE '' END
                    ELSE 'cache-control=no-cache|content-length=0|etag='
                        || CASE WHEN page_id % 4 = 1 AND NOT bare THEN 'W/' ELSE '' END || coalesce(tag, '')
                        || '|last-modified=' || coalesce(modified, '') END AS headers
        FROM judged""",
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        q AS (
            SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
        asked AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM q) GROUP BY ALL),
        total AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d WHERE len(ts) > 0),
        held AS (
            SELECT n, t, count(*) AS tf FROM (SELECT n, unnest(ts) AS t FROM d) GROUP BY ALL
            HAVING t IN (SELECT t FROM asked)),
        weights AS (
            SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM held, total GROUP BY t, docs),
        shares AS (
            SELECT n, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(ts) * docs) // words))) AS share
            FROM held JOIN weights USING (t) JOIN d USING (n), total),
        scored AS (
            SELECT i, item_id, n, CAST(sum(times * share) AS BIGINT) AS score FROM asked JOIN shares USING (t) GROUP BY ALL),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
            FROM scored JOIN d USING (n) WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op12_mixing": r"""
        WITH d AS (
            SELECT row_number() OVER () AS n, doc_id, source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums),
        weighed AS (
            SELECT *, [3, 1, 2][place % 3 + 1] AS weight, source_size * 2 AS cap,
                   CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM placed),
        levels AS (
            SELECT *, cap <= weight * ((budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, place
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS stopped FROM weighed),
        targets AS (
            SELECT source, source_size, place, budget, CASE WHEN stopped THEN CAST(cap AS DOUBLE)
                       ELSE weight * ((budget - coalesce(sum(cap) FILTER (stopped) OVER (), 0))
                           / sum(weight) FILTER (NOT stopped) OVER ()) END AS target FROM levels),
        positions AS (
            SELECT d.n, d.doc_id, d.size, t.source_size, t.place, t.target, t.budget,
                   CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source
                       ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS LAST, size, n
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        copies AS (
            SELECT *, start + pass * source_size AS first FROM positions, (VALUES (0), (1)) AS p(pass)
            WHERE size > 0 AND start + pass * source_size < target),
        units AS (SELECT *, CASE WHEN first + size <= target THEN size ELSE 16 END AS unit FROM copies),
        pieces AS (
            SELECT place, target, budget, first + piece * unit AS start, least(unit, size - piece * unit) AS words
            FROM (SELECT *, unnest(range((size - 1) // unit + 1)) AS piece FROM units)),
        queued AS (
            SELECT *, coalesce(sum(words) OVER (ORDER BY (start + words) / target, place, start
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM pieces WHERE start < target),
        given AS (SELECT place, sum(greatest(0, least(floor(budget) - ahead, words))) AS given FROM queued GROUP BY place)
        SELECT doc_id, size, source_size, target, CAST(
                   greatest(0, least(size, coalesce(given, 0) - start))
                   + greatest(0, least(size, coalesce(given, 0) - start - source_size)) AS BIGINT) AS taken
        FROM positions LEFT JOIN given USING (place)""",
}
