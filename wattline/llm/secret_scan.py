"""Secret scans (operator 8) over a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: the texts that can match
hold all trigrams of at least one of its alternatives. The index has a posting (trigram, text) for
every trigram that some query asks for; postings are intersected by counting them for each text and
alternative. Only those candidates run the rule's expression. A rule without mandatory trigrams, such
as one for hexadecimal digits, runs on every text.

Texts are named by a hash in the index. Two texts with one hash share their candidates, which can only
add rules to verify, so results do not depend on it.

A rule's matches are found from left to right without overlap; a match whose value is shorter than the
rule's least length is dropped afterwards. Spans count code points, the end is exclusive. Null texts
count as empty and have no span. An empty table gives no row.
"""

from dataclasses import dataclass
from itertools import product

from pyspark.sql import functions as F

from wattline.llm.common import free_name, materialize

try:
    from re import _parser as syntax
except ImportError:  # before Python 3.11
    import sre_parse as syntax


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` of ``pattern`` must have ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, then public formats of keys.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"(?:xoxb|xoxp|xoxa|xoxr|xoxs)-[0-9A-Za-z-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
MASK = "[SECRET]"
# Matches added up one by one; a text with more is added up block by block.
BLOCK = 128

# Alternatives of an expression that are followed; beyond that, a part counts as a gap.
WIDEST = 64
CLASS = 8  # letters of a class that stand for alternatives, as the parser folds (?:ab|ac) into a[bc]
GAP = "\0"


def alternatives(parsed):
    """Strings that stand for a parsed expression: literal letters in lower case, and gaps."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            found = [chr(value).lower()]
        elif name == "IN" and len(value) <= CLASS and all(str(k) == "LITERAL" for k, _ in value):
            found = sorted({chr(c).lower() for _, c in value})
        elif name == "SUBPATTERN":
            found = alternatives(value[-1])
        elif name == "BRANCH":
            found = [x for branch in value[1] for x in alternatives(branch)]
        elif name == "MAX_REPEAT":
            least, most, inner = value
            once = alternatives(inner)
            found = ["", *once] if (least, most) == (0, 1) else [x + GAP for x in once] if least else [GAP]
        else:  # larger classes, anchors and the rest say nothing about letters
            found = [GAP]
        if len(out) * len(found) > WIDEST:
            found = [GAP]
        out = [a + b for a, b in product(out, found)]
    return out


def trigram_query(pattern):
    """A list of trigram sets; a match needs all of one set. None: the rule has to run on every text."""
    sets = set()
    for string in alternatives(syntax.parse(pattern)):
        grams = {run[i : i + 3] for run in string.split(GAP) for i in range(len(run) - 2)}
        if not grams:
            return None
        sets.add(frozenset(grams))
    # A set that holds all of another adds nothing.
    return sorted((sorted(s) for s in sets if not any(o < s for o in sets)))


def postings(df, grams, text="text"):
    """(text_key, gram): the trigrams of each distinct text, among ``grams``, whatever their case."""
    low = df.select(F.xxhash64(df[text]).alias("text_key"), F.lower(df[text]).alias("low"))
    present = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    held = low.select("text_key", F.array_compact(F.array(*present)).alias("grams"))
    # Outer, as for a plain explode Spark would first test, and so compute, the array a second time.
    return held.select("text_key", F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL").distinct()


def candidates(df, rules=RULES, text="text"):
    """Written (text_key, rules): the places of the rules whose trigram query the text satisfies."""
    spark = df.sparkSession
    terms = [
        (r, c, gram, len(grams))
        for r, rule in enumerate(rules) for c, grams in enumerate(trigram_query(rule.pattern) or ())
        for gram in grams
    ]
    schema = "rule int, clause int, gram string, needed int"
    asked = spark.createDataFrame(terms, schema)
    index = postings(df, sorted({t[2] for t in terms}), text)
    met = index.join(asked, "gram").groupBy("text_key", "rule", "clause").agg(
        F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed")).where("n = needed")
    return materialize(met.groupBy("text_key").agg(F.collect_set("rule").alias("rules")), "candidates")


def with_candidates(df, rules=RULES, text="text"):
    """``df`` with the places of its candidate rules, and the name of that column."""
    key, held = free_name(df, "text_key"), free_name(df, "rules_held")
    found = candidates(df, rules, text).select(F.col("text_key").alias(key), F.col("rules").alias(held))
    joined = df.withColumn(key, F.xxhash64(df[text])).join(found, key, "left").drop(key)
    return joined.withColumn(held, F.coalesce(F.col(held), F.array().cast("array<int>"))), held


def is_asked(held, rules, i):
    """Whether a text is a candidate of rule ``i``; a rule without trigrams has every text."""
    return F.lit(True) if trigram_query(rules[i].pattern) is None else F.array_contains(F.col(held), i)


def parts(text, rule):
    """Array of (before, match, kept): the text before each match of a rule, the match, and whether
    its value is long enough; the last element is the rest of the text with a null match."""
    pattern = F.lit(rule.pattern)
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    return F.transform(
        F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("before"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
            F.transform(value, lambda x: F.length(x) >= rule.least).alias("kept"),
        ),
        lambda x: F.struct(x["before"].alias("before"), x["match"].alias("match"),
                           F.coalesce(x["kept"], F.lit(False)).alias("kept")),
    )


def running(values, first, step):
    """For each element of an array of whole numbers, the outcome of ``step`` over those ahead of it.

    ``step`` is associative. Elements are taken in blocks, as an array that grows one by one is copied
    for each: a long array costs the blocks' own work, and not the square of its length.
    """
    def ahead(array, start):
        none = F.array().cast("array<int>")
        return F.aggregate(
            array, F.struct(start.alias("at"), none.alias("out")),
            lambda seen, x: F.struct(step(seen["at"], x).alias("at"), F.concat(seen["out"], F.array(seen["at"])).alias("out")),
            lambda seen: seen["out"])

    count = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.when(F.size(values) > 0, F.transform(
        F.sequence(F.lit(0), count), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(
        F.array().cast("array<array<int>>"))
    start = F.lit(first)
    before = ahead(F.transform(blocks, lambda x: F.aggregate(x, start, step)), start)
    return F.flatten(F.zip_with(blocks, before, ahead))


def spans(text, rule, order):
    """Array of (start, rule, end) of a rule's matches."""
    found = parts(text, rule)
    size = F.transform(found, lambda x: F.length(x["before"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
    placed = F.zip_with(found, running(size, 0, lambda a, b: a + b), lambda x, at: F.struct(
        (at + F.length(x["before"])).alias("start"), F.lit(order).alias("rule"),
        (at + F.length(x["before"]) + F.length(x["match"])).alias("end"), x["kept"].alias("kept")))
    kept = F.transform(F.filter(placed, lambda x: x["kept"]), lambda x: F.struct(
        x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end")))
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.array().cast("array<struct<start:int,rule:int,end:int>>"))


def scan(df, rules=RULES, text="text"):
    """``df`` with ``spans``, an array of (start, rule, end) by start, then rule; ``rule`` is the
    place in ``rules``. A column of that name is replaced."""
    found, bits = with_candidates(df, rules, text)
    whole = free_name(found, "whole_text")
    found = found.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    names = []
    for i, rule in enumerate(rules):
        names.append(free_name(found, f"spans_{i}"))
        asked = is_asked(bits, rules, i)
        empty = F.array().cast("array<struct<start:int,rule:int,end:int>>")
        found = found.withColumn(names[-1], F.when(asked, spans(F.col(whole), rule, i)).otherwise(empty))
    return found.withColumn("spans", F.sort_array(F.concat(*names))).drop(bits, whole, *names)


def listed(column, rules=RULES):
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(df, text="text", key="doc_id", rules=RULES, base=len(BASE)):
    """One row for every row of the table: key, a count for each base kind, digest of the base spans,
    and all spans as text."""
    found = scan(df.select(df[key].alias("key"), df[text].alias("text")), rules, "text")
    first = F.filter("spans", lambda s: s["rule"] < base)

    def count(i):
        return F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long").alias(f"n_{rules[i].kind}")

    counts = [count(i) for i in range(base)]
    return found.select(
        F.col("key").alias(key), *counts, F.sha2(listed(first, rules), 256).alias("base_sha256"),
        listed(F.col("spans"), rules).alias("spans"))


def mask_secrets(df, rules=RULES, text="text", mask=MASK):
    """``df`` with every secret in the text replaced by ``mask``; other texts, and null ones, stay as they
    are. Spans are those of the text as it comes; spans that overlap are one secret."""
    # ``scan`` replaces a column named spans; one of the table's own is put aside meanwhile.
    aside, own = free_name(df, "spans_aside"), next((c for c in df.columns if c.lower() == "spans"), None)
    found = scan(df.withColumnRenamed(own, aside) if own else df, rules, text)
    at = F.col("spans")
    covered = running(F.transform(at, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b))
    pieces = F.zip_with(at, covered, lambda x, c: F.when(
        x["start"] >= c, F.concat(F.substring(F.col(text), c + 1, x["start"] - c), F.lit(mask))).otherwise(F.lit("")))
    last = F.array_max(F.transform(at, lambda x: x["end"]))
    put = F.concat(F.array_join(pieces, ""), F.substring(F.col(text), last + 1, F.length(text)))
    found = found.withColumn(text, F.when(F.size(at) > 0, put).otherwise(F.col(text))).drop("spans")
    return (found.withColumnRenamed(aside, own) if own else found).select(*df.columns)
