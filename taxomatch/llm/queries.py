"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.llm import alignment, bpe_codec, bpe_count, chat, hpylm, lattice, mixing, nearest, packing, quality, recompress, runs, simhash, sql
from taxomatch.llm.common import crc_mod, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), length=2048, end_id=1, with_ids=False)


def op2_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op3_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one made of control strings, read
    back from its formatted windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.windows(turns.unionAll(probe), budget=512, history=128))


def op4_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_e8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op7_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without repeated windows of 35 words."""
    return recompress.removal_digests(table(spark, sf_dir, "documents"), window=35)


def op8_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from nine tenths of them."""
    return hpylm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op9_block_matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))  # a null id is held out of nothing
    return quality.score(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by their id, go on with one period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them with a planted one."""
    return runs.run_digests(table(spark, sf_dir, "documents"), min_words=24, times=3, rewrite=planted_period)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment_digests(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op13_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of all sources takes."""
    return mixing.taken(table(spark, sf_dir, "documents"), block=256, shard=1024, most=3)


QUERIES = {f.__name__: f for f in (op1_cost_balanced_packing, op2_simhash_tiles, op3_budgeted_chat, op4_chunk_reuse_bpe, op5_e8_near_dedup, op6_heap_token_counts, op7_recompression_dedup, op8_pitman_yor_scores, op9_block_matrix_search, op10_subword_quality,
                                  op11_periodic_runs, op12_cross_tokenizer_alignment, op13_weighted_mix)}
ORACLE_SQL: dict[str, str] = {
    "op3_budgeted_chat": sql.OP3,
    "op5_e8_near_dedup": sql.OP5,
    "op7_recompression_dedup": sql.OP7,
    "op9_block_matrix_search": sql.OP9,
    "op11_periodic_runs": sql.OP11,
    "op13_weighted_mix": sql.OP13,
}
