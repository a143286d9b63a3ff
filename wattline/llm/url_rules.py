"""URL filters (operator 1): pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` of a URL, with an action and a weight. Its literal
tokens are the runs of ASCII letters and digits that every matching URL must hold as whole tokens, where
capitals may count as letters or as what ends a run. Over
the table, Spark counts in how many URLs each such token occurs; every rule is filed under its rarest
one. A URL is split into its tokens, the tokens fetch candidate rules, and only those run their
regular expressions. Rules without a literal token are candidates for every URL. Of the rules that
match, the one with the largest weight decides, among equals the one that comes first.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: what
follows up to ``?``, ``#`` or the end. A null URL or one without ``://`` has an empty host and path.

The index holds rules only; it is refused above ``MOST_BYTES``, as every task gets a copy. URLs are
judged row by row where they lie, so repeated rows, null keys and hot hosts need no care and nothing
is shuffled but token counts. An empty table gives no row.
"""

import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from wattline.llm.common import map_batches

ALLOW, BLOCK = "allow", "block"
MOST_BYTES = 64 << 20
TOKEN, LOWER_TOKEN = re.compile("[0-9A-Za-z]+"), re.compile("[0-9a-z]+")


@dataclass(frozen=True)
class UrlRule:
    """``name`` is what a report shows; a null name is a rule of the method's own. ``tokens`` must occur in
    every URL that ``pattern`` matches, in lower case: as whole runs of letters and digits, or as whole
    runs of lower-case letters and digits."""

    name: str | None
    pattern: str
    verdict: str
    weight: int
    tokens: tuple


def site_rule(text, verdict):
    """A rule ``host/path``: it fits the host and its subdomains, where the path starts with the rule's.
    The longest wins, and all of them win over rules of other kinds."""
    host, slash, path = text.partition("/")
    path = slash + path
    # The last token of the path may go on in a URL's path, the others are whole.
    whole = TOKEN.findall(host) + [m.group() for m in TOKEN.finditer(path) if m.end() < len(path)]
    pattern = rf"(?s)(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return UrlRule(text, pattern, verdict, 1 << 20 | len(text), tuple(t.lower() for t in whole))


def pattern_rule(pattern, verdict, tokens=(), weight=0):
    """A rule of the method's own: a regular expression, searched for in ``host + path``."""
    return UrlRule(None, "(?s).*(?:" + pattern + ")", verdict, weight, tuple(tokens))


def split_url(url):
    """(host, path) of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(LOWER), rest[:stop]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def token_counts(df, rules, url="url"):
    """{token: number of URLs that hold it} for the tokens of the rules; one number for each of
    them reaches the driver."""
    asked = sorted({t for r in rules for t in r.tokens})
    held = F.array_union(F.split(F.lower(df[url]), "[^0-9a-z]+"), F.split(df[url], "[^0-9a-z]+"))
    wanted = F.filter(held, lambda t: t.isin(asked))
    counts = df.select(F.explode(wanted).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in asked} | {r["token"]: r["count"] for r in counts}


def rule_index(rules, counts):
    """{rarest token: places of its rules}; rules without a token are under None."""
    index = {}
    for place, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts[t], t), default=None)
        index.setdefault(rarest, []).append(place)
    return index


def judge_urls(df, rules, url="url", key="page_id", default=ALLOW):
    """(key, host, path, rule, verdict): one row for every row of the table. ``rule`` is null where a
    rule of the method's own or the default decides."""
    rules = list(rules)
    if sum(len(r.pattern) + len(r.name or "") for r in rules) > MOST_BYTES:
        raise ValueError("too many rules for a copy in every task")
    index = rule_index(rules, token_counts(df, rules, url))

    def run(batch):
        checks = compiled(rules)
        out = {"key": batch["key"], "host": [], "path": [], "rule": [], "verdict": []}
        for x in batch["url"].to_pylist():
            host, path = split_url(x)
            tokens = {*TOKEN.findall((host + path).lower()), *LOWER_TOKEN.findall(host + path)}
            places = [p for t in (*tokens, None) for p in index.get(t, ())]
            hits = [p for p in places if checks[p].match(host + path)]
            best = max(hits, key=lambda p: (rules[p].weight, -p), default=None)
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(None if best is None else rules[best].name)
            out["verdict"].append(default if best is None else rules[best].verdict)
        return out

    kind = df.schema[key].dataType.simpleString()
    picked = df.select(df[key].alias("key"), df[url].alias("url"))
    schema = f"key {kind}, host string, path string, rule string, verdict string"
    return map_batches(picked, run, schema).withColumnRenamed("key", key)


def compiled(rules):
    return [re.compile(r.pattern) for r in rules]
