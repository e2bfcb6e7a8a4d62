"""Lexical scoring: BM25 (Okapi) index over the KB and title-word overlap.

The index is built with Spark group-bys over the KB corpus; each KB row ends
up with ``bm25_terms``: ``array<struct<token, weight>>`` where

    weight(t, d) = idf(t) * tf(t,d) * (k1 + 1) / (tf(t,d) + k1 * (1 - b + b * dl(d) / avgdl))

so the score of a query is ``sum over query tokens (with repeats) of
weight(t, d)`` - one sparse dot product, done inside ``match``.
idf(t) = ln((N - n(t) + 0.5) / (n(t) + 0.5)); a negative idf is replaced by
``epsilon * mean(idf)`` (mean over all corpus terms, negatives included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.functions.text import joined_parts, tokens
from taxomatch.operators.topk import sparse_topk

# Okapi BM25 defaults.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25


def corpus_text(title, alt, desc, caps=None):
    """Title, alternate titles and description, empty parts skipped, joined by
    spaces; whole unless ``caps`` are given (the reference keeps 200 / 300
    characters of the last two)."""
    return joined_parts((title, alt, desc), caps)


def bm25_postings(corpus: DataFrame, key: str = "code", text: str = "text",
                  k1: float = BM25_K1, b: float = BM25_B, epsilon: float = BM25_EPSILON) -> DataFrame:
    """Long form of the index: (key, token, tf, dl, n, idf, weight)."""
    docs = corpus.select(key, tokens(text).alias("_toks"))
    dl = docs.select(key, F.size("_toks").alias("dl"))
    # corpus-level scalars are collected (two numbers), not cross-joined
    st = dl.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl")).collect()[0]
    n_docs, avgdl = int(st["N"]), float(st["avgdl"] or 0.0)
    tf = (docs.select(key, F.explode_outer("_toks").alias("token")).where("token is not null")
          .groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")))
    raw = (tf.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
           .withColumn("raw_idf", F.log((F.lit(float(n_docs)) - F.col("n") + 0.5) / (F.col("n") + 0.5))))
    mean_idf = float(raw.agg(F.avg("raw_idf")).collect()[0][0] or 0.0)
    idf = (raw.withColumn("idf", F.when(F.col("raw_idf") < 0, F.lit(epsilon * mean_idf))
                          .otherwise(F.col("raw_idf")))
           .withColumn("avgdl", F.lit(avgdl))
           .select("token", "n", "idf", "avgdl"))
    post = tf.join(dl, key).join(idf, "token")
    w = F.col("idf") * F.col("tf") * F.lit(k1 + 1) / (
        F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    return post.select(key, "token", "tf", "dl", "n", "idf", w.alias("weight"))


def bm25_index(corpus: DataFrame, key: str = "code", text: str = "text", **kw) -> DataFrame:
    """Per KB row: ``bm25_terms`` array<struct<token, weight>> (KB-sized)."""
    post = bm25_postings(corpus, key, text, **kw)
    return (post.groupBy(key)
            .agg(F.collect_list(F.struct("token", "weight")).alias("bm25_terms")))


def overlap_topk(queries: DataFrame, kb: DataFrame, k: int = 3, query_id: str = "query_id") -> DataFrame:
    """(query_id, rank, code, overlap): the ``k`` KB rows that share most words
    with a query, ties by code; KB rows that share none are not listed. Both
    sides hold ``title_words`` (word sets). Query rows with equal ids are one
    query; ``topk`` says which words are joined at all."""
    words = queries.select(query_id, F.explode_outer("title_words").alias("token"))  # outer: the words are not made twice, once for a size filter
    known = kb.select("code", F.explode_outer("title_words").alias("token")).where("token is not null").distinct().withColumn("weight", F.lit(1.0))
    best = sparse_topk(words, known, kb.select("code"), k, query_id, repeats=False)
    return best.select(query_id, "rank", "code", F.col("score").cast("long").alias("overlap"))


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, query_id: str = "query_id", text: str = "text", **kw) -> DataFrame:
    """(query_id, rank, code, score): the ``k`` rows of ``corpus`` (code, text)
    with the highest BM25 score for a query's ``tokens``, by the query's highest
    score if that is positive; fewer hits than ``k`` are followed by the lowest
    codes at 0. Query rows with equal ids are one query."""
    words = queries.select(query_id, F.explode_outer("tokens").alias("token"))
    best = sparse_topk(words, bm25_postings(corpus, "code", text, **kw), corpus.select("code"), k, query_id, fill=queries)
    return best.select(query_id, "rank", "code", F.col("relative").alias("score"))
