"""The corpus pipeline: five stages over documents, each written as Parquet before the next.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the
last return the columns of documents; n_chars follows the text. Nulls in any column, empty and very
long texts, repeated rows and an empty table go through every stage as its operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from parqlane.llm import bpe, common, gam, line_dedup, mixing, simhash


def quality(spark, docs, sf_dir):
    """Documents whose score is below the threshold go; null texts are scored like empty ones."""
    model = gam.train(docs, common.read(spark, sf_dir, "labels", "doc_id", "quality"))
    name = common.unused("score", docs.columns)
    scored = gam.score_quality(docs, model, name=name)
    return scored.where(F.col(name) >= gam.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_lines(spark, docs, sf_dir):
    """Every class of equal or nearly equal lines stays once; a document may become empty."""
    found = line_dedup.dedup_lines(docs)
    text = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(text.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark, docs, sf_dir):
    """One document of each group stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Whole and partial copies by each source's quota; partial texts are the taken words."""
    return mixing.mixed_documents(docs)


def encode(spark, docs, sf_dir):
    """Token ids of each text, and whether they decode to it again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. A stage's input and scratch tables go once its own output is written."""
    docs, place = common.read(spark, sf_dir, "documents"), common.mark()
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage")
        common.discard_since(spark, place, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
