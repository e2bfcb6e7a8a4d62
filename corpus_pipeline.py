"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.llm import packing, quality, recompress, simhash
from taxomatch.llm.common import fresh_name, saved, table
from taxomatch.llm.queries import WORD_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from a bounded sample
    of the labelled ones (quality.PER_CLASS of each class)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within two bits."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows of 35 words; n_chars
    follows the text. A document that repeats others whole stays, empty."""
    removed = fresh_name(docs, "_removed")
    out = recompress.without_repeats(docs, window=35, removed=removed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def cost_balanced_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, with their ids, in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), length=2048, end_id=1)


STAGES = [
    ("quality", quality_classifier),
    ("simhash", simhash_near_dedup),
    ("substring", substring_dedup),
    ("packing", cost_balanced_packing),
]

#: Hashes, learned models and tokenisers have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each to what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
