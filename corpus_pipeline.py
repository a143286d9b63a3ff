"""The corpus pipeline: language ID, exact dedup, near dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's rows as Parquet below ``spark.checkpoint.dir`` and gives
what it reads back to the next one.
"""

import public_tokenizers
from pyspark.sql import functions as F

from wattline.llm.common import free_name, materialize, prepare
from wattline.llm.exact_dedup import drop_exact_duplicates
from wattline.llm.language_id import UNKNOWN, predict, profiles
from wattline.llm.packing import pack
from wattline.llm.secret_scan import mask_secrets
from wattline.llm.simhash import drop_near_duplicates

# Below this share of the support that a language's own rows have, a text is unlike that language.
LEAST_SHARE = 0.25
VOCABULARY = "word_bpe_49k.json"


def language_id(spark, docs, sf_dir):
    """Texts without a letter, and those unlike every learned language, go. Languages are learned from
    the rows that name one; where none does, only texts without a letter go."""
    prepare(spark)
    known, supports = profiles(docs)
    if not known:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    names = {c: free_name(docs, c) for c in ("lang_pred", "score", "share", "whole_text")}
    # The text is looked at in a copy, as prediction returns all columns but the one it reads.
    rows = docs.withColumn(names["whole_text"], docs["text"])
    found = predict(rows, known, names["whole_text"], names["lang_pred"], names["score"], supports, names["share"])
    like = F.coalesce(F.col(names["share"]) >= LEAST_SHARE, F.lit(True))
    likely = (F.col(names["lang_pred"]) != UNKNOWN) & like
    return found.where(likely).select(*docs.columns)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts one document stays, the one with the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near copies (four-word shingles, at most four bits apart) one document stays, the
    one with the smallest id."""
    prepare(spark)
    return drop_near_duplicates(docs)


def secrets(spark, docs, sf_dir):
    """Secrets are masked in the text; every document stays. n_chars follows the text."""
    masked = mask_secrets(docs)
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.withColumn("n_chars", changed) if "n_chars" in docs.columns else masked


def packing(spark, docs, sf_dir):
    """Pieces of sequences of 2,048 ids."""
    prepare(spark)
    return pack(docs, public_tokenizers.path(VOCABULARY), with_ids=False)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("secrets", secrets), ("packing", packing),
]

# No SQL: language vectors, SimHash and byte pairs are beyond it. Tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows, each stage reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
