"""Text encoders: text column -> dense ``vec`` (array<double>).

The reference encodes with a sentence-transformer; its weights are not
available, so the encoder is pluggable:

* ``HashingEncoder`` - built in, no downloads: whitespace tokens -> bucket (the
  first 32 bits of their MD5, modulo the dimension, which SQL can repeat) ->
  counts -> inverse document frequency (fitted once on a corpus, one pass) ->
  scaled to length 1. Spark lower-cases; tokens are counted in Arrow batches.
* ``BatchEncoder`` - wraps any ``list[str] -> np.ndarray`` model in an
  iterator pandas UDF: a model is loaded once per Python worker and fed
  batches of texts of like length. ``pooled_table_model`` is one.

``encode_chunked`` splits long text into 800-character chunks, encodes every
chunk and averages per row (not re-normalised); blank text gives the zero
vector. ``encode_weighted_tasks`` averages task vectors with their weights.
"""

from __future__ import annotations

import math
import uuid
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxomatch.functions.text import chunk_flat, is_blank, single_spaced
from taxomatch.operators.centroid import vector_mean, weighted_centroid
from taxomatch.session import ship_package

try:
    from _md5 import md5  # the interpreter's own: twice as fast on short texts
except ImportError:
    from hashlib import md5


PIECE_ROWS, PIECE_BYTES = 8192, 32 << 20  # texts that are counted at a time


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of neighbours, bounded in rows and, but for a single
    longer text, in bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        room = (ends[at - 1] if at else 0) + PIECE_BYTES
        to = max(at + 1, min(at + PIECE_ROWS, int(np.searchsorted(ends, room, side="right"))))
        yield texts.slice(at, to - at)
        at = to


def bucket_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """(texts, dim) counts of the buckets of lower-cased texts' tokens: the first
    32 bits of a token's MD5, modulo the dimension, made once per distinct token.
    Arrow's whitespace is that of Python's ``str.split``."""
    found = pc.utf8_split_whitespace(texts)
    lens = found.value_lengths().to_numpy(zero_copy_only=False)
    words = found.flatten().dictionary_encode()
    names = words.dictionary.cast(pa.binary()).to_pylist()
    head = b"".join([md5(w).digest()[:4] for w in names])
    slot = np.frombuffer(head, dtype=">u4").astype(np.int64) % dim
    slot[[k for k, w in enumerate(names) if not w]] = dim  # around whitespace at the ends: counted apart
    cells = np.repeat(np.arange(len(texts), dtype=np.int64) * (dim + 1), lens) + slot[words.indices.to_numpy()]
    return np.bincount(cells, minlength=len(texts) * (dim + 1)).reshape(len(texts), dim + 1)[:, :dim]


def _lowered(text: str) -> Column:
    # Spark's lower case; Python's split has the tokens of text.tokens
    return F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


SPARSE = "struct<dim:int,pos:array<int>,value:array<double>>"


class HashingEncoder:
    def __init__(self, dim: int = 384, min_doc_freq: int = 0):
        self.dim = dim
        self.min_doc_freq = min_doc_freq
        self.idf: np.ndarray | None = None

    def fit(self, corpus: DataFrame, text: str = "text") -> "HashingEncoder":
        """Rows of the corpus that hold each bucket, counted by task and summed."""
        ship_package(corpus.sparkSession)
        dim = self.dim

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(dim + 1, dtype=np.int64)  # the last: all rows
            for batch in batches:
                for texts in pieces(batch.column(0)):
                    held[:dim] += (bucket_counts(texts, dim) > 0).sum(axis=0)
                    held[dim] += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(held)], ["pos", "n"])

        part = corpus.select(_lowered(text).alias("_text")).mapInArrow(count, "pos long, n long")
        held = {r["pos"]: r["n"] for r in part.groupBy("pos").agg(F.sum("n").alias("n")).collect()}  # dim + 1 rows
        rows = held.get(dim, 0)
        if not rows:
            raise ValueError("the corpus is empty")
        self.idf = np.array([math.log((rows + 1.0) / (held[k] + 1.0)) if held[k] >= self.min_doc_freq else 0.0 for k in range(dim)])
        return self

    def __call__(self, df: DataFrame, text: str = "text", out: str = "vec", sparse: bool = False) -> DataFrame:
        """``sparse`` gives the non-zero components alone (``SPARSE``), which
        matching and weight search take as they take a dense ``vec``."""
        if self.idf is None:
            raise ValueError("fit the encoder first")
        ship_package(df.sparkSession)
        dim, idf = self.dim, self.idf

        @F.arrow_udf(SPARSE if sparse else "array<double>")
        def enc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                parts = [unit_counts(bucket_counts(texts, dim), idf) for texts in pieces(batch)]
                row = np.cumsum([0] + [p[0] for p in parts])
                ends = np.concatenate([np.zeros(1, np.int64)] + [p[1] for p in parts]).cumsum()
                pos, value = (np.concatenate([np.zeros(0, kind)] + [p[k] for p in parts]) for k, kind in ((2, np.int64), (3, np.float64)))
                n = int(row[-1])
                if sparse:
                    ends = pa.array(ends, pa.int32())
                    yield pa.StructArray.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(pos, pa.int32())),
                                                      pa.ListArray.from_arrays(ends, pa.array(value))], ["dim", "pos", "value"])
                else:
                    flat = np.zeros(n * dim)
                    flat[np.repeat(np.arange(n, dtype=np.int64) * dim, np.diff(ends)) + pos] = value
                    yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(flat))

        return df.withColumn(out, enc(_lowered(text)))


def unit_counts(counts: np.ndarray, idf: np.ndarray) -> tuple:
    """(rows, non-zero counts per row, their places, their components): counts
    times ``idf``, each row scaled to length 1; the zero row stays zero."""
    rows, pos = np.nonzero(counts)
    value = counts[rows, pos] * idf[pos]
    norm = np.sqrt(np.bincount(rows, weights=value * value, minlength=len(counts)))[rows]
    value = np.divide(value, norm, out=np.zeros_like(value), where=norm > 0)
    return len(counts), np.bincount(rows, minlength=len(counts)), pos, value


_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}  # of this worker process


def worker_model(token: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """The encoder's model, loaded by the first task of a worker process and kept
    for its later ones."""
    if token not in _MODELS:
        _MODELS.clear()  # a worker holds one model at a time
        _MODELS[token] = load()
    return _MODELS[token]


def length_batches(lengths: np.ndarray, max_rows: int, max_chars: int) -> Iterator[np.ndarray]:
    """Places of texts in batches of at most ``max_rows``, texts of like length
    together, so that a batch padded to its longest text holds at most
    ``max_chars`` characters; a text longer than that is a batch of its own."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, min(max_rows, max_chars // max(int(lengths[order[at]]), 1)))
        yield order[at:at + rows]
        at += rows


class BatchEncoder:
    """Any batch model as an iterator pandas UDF (Arrow batches). ``load`` is
    shipped with the job and called once per worker process; the model gets
    non-empty lists of whole texts (null: empty) of like length, and returns a
    row of ``dim`` numbers for each. A text's vector must not depend on the
    others in its batch."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, max_rows: int = 256, max_chars: int = 1 << 20):
        self.load, self.dim, self.max_rows, self.max_chars = load, dim, max_rows, max_chars
        self.token = uuid.uuid4().hex

    def __call__(self, df: DataFrame, text: str = "text", out: str = "vec") -> DataFrame:
        ship_package(df.sparkSession)
        load, dim, token, max_rows, max_chars = self.load, self.dim, self.token, self.max_rows, self.max_chars

        @F.pandas_udf("array<double>")
        def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                texts = s.fillna("").tolist()
                m = np.zeros((len(texts), dim))
                for rows in length_batches(np.array([len(t) for t in texts], dtype=np.int64), max_rows, max_chars):
                    part = np.asarray(worker_model(token, load)([texts[k] for k in rows]), dtype=np.float64)
                    if part.shape != (len(rows), dim):
                        raise ValueError(f"the model gave {part.shape} for {len(rows)} texts of {dim} dimensions")
                    m[rows] = part
                yield pd.Series(list(m))

        return df.withColumn(out, enc(F.col(text)))


def pooled_table_model(dim: int, slots: int = 1 << 12) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Loader of a small deterministic model: the mean of one table row per token
    (the token's slot by its MD5), with a saturating output. The table is
    arithmetic, so that SQL can repeat it."""

    def load():
        table = ((np.arange(slots)[:, None] * 31 + np.arange(dim)[None, :] * 17) % 101 - 50) / 50.0

        def model(texts: list[str]) -> np.ndarray:
            found = [[int(md5(t.encode()).hexdigest()[:8], 16) % slots for t in x.lower().split()] for x in texts]
            counts = np.array([len(f) for f in found])
            sums = np.zeros((len(texts), dim))
            np.add.at(sums, np.repeat(np.arange(len(texts)), counts), table[np.array([k for f in found for k in f], dtype=np.int64)])
            mean = sums / np.maximum(counts, 1)[:, None]
            return mean / np.sqrt(1.0 + mean * mean)

        return model

    return load


def encode_chunked(df: DataFrame, key: str, text: str, encoder, out: str = "vec", width: int = 800) -> DataFrame:
    """Mean of chunk vectors per row; blank text -> zero vector. Chunks are
    exploded (one row per chunk) so long texts spread over tasks."""
    # a column of its own: the generator would make the spaced text anew at each mention
    flat = df.select(key, single_spaced(text).alias("_flat"))
    # outer, then a filter: a plain explode would make the chunks twice, once for a size filter of the optimizer
    chunks = flat.select(key, F.explode_outer(chunk_flat("_flat", width, hyphens=True)).alias("_chunk")).where("_chunk is not null")
    enc = encoder(chunks, "_chunk", "_cv")
    mean = vector_mean(enc, key, "_cv", out)
    dim = encoder.dim
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.select(key).distinct().join(mean, key, "left").withColumn(out, F.coalesce(F.col(out), zero))


TASKS_SCHEMA = "array<struct<task:string,weight:double>>"


def encode_weighted_tasks(tasks: DataFrame, key: str, encoder, out: str = "vec_task") -> DataFrame:
    """``tasks``: (key, tasks) with tasks as array<struct<task, weight>> or its
    JSON text. Weighted mean of the task vectors (a missing weight is 0.5);
    empty task text is skipped; no task or bad JSON -> zero vector."""
    if dict(tasks.dtypes)["tasks"] == "string":
        tasks = tasks.withColumn("tasks", F.from_json("tasks", TASKS_SCHEMA))
    items = (tasks.select(key, F.posexplode_outer("tasks").alias("_pos", "_t"))
             .select(key, "_pos", F.col("_t.task").alias("_task"),
                     F.coalesce(F.col("_t.weight"), F.lit(0.5)).alias("_w")))
    valid = items.where(~is_blank("_task"))
    enc = encoder(valid, "_task", "_tv")
    mean = weighted_centroid(enc, key, "_tv", "_w", out)
    zero = F.array_repeat(F.lit(0.0), encoder.dim)
    return tasks.select(key).join(mean, key, "left").withColumn(out, F.coalesce(F.col(out), zero))


# KB field -> source column for the six-field encode job, and for
# the app variant (there the task slot encodes the title).
KB_FIELD_COLUMNS = {"desc": "description", "skill": "all_tech_skills", "ofc_title": "title",
                    "alt_title": "all_alt_titles", "tool": "all_tools"}
APP_COLUMNS = {"task": "title", "desc": "description", "skill": "all_tech_skills", "ofc_title": "title",
               "alt_title": "all_alt_titles", "tool": "all_tools"}


def kb_vectors(kb: DataFrame, encoder, mode: str = "chunk", caps: dict[str, int] | None = None) -> DataFrame:
    """Encode the six KB fields.

    ``whole`` (app): the task slot encodes the title and every field is encoded
    as one text, whole unless ``caps`` names a number of characters for it (the
    reference keeps 400 of desc, 300 of skill and alt_title, 200 of tool);
    every field is one more narrow column transform on the same rows (no
    shuffle, no join). ``chunk``: tasks weighted by importance, other fields
    chunk-meaned; all five text fields are exploded into chunks in one pass,
    encoded once and averaged per (code, field). Codes must be unique."""
    if mode == "whole":
        out = kb
        for f, c in APP_COLUMNS.items():
            src = F.coalesce(F.col(c), F.lit("")) if c in kb.columns else F.lit("")
            out = out.withColumn("_txt", F.left(src, F.lit(caps[f])) if caps and f in caps else src)
            out = encoder(out, "_txt", f"vec_{f}").drop("_txt")
        return out
    fields = [(f, c) for f, c in KB_FIELD_COLUMNS.items() if c in kb.columns]
    long = kb.select("code", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("text"))
                                                 for f, c in fields])).alias("_ft"))
    long = long.select("code", F.col("_ft.field").alias("field"), F.col("_ft.text").alias("text"))
    long = long.withColumn("_key", F.concat_ws("\u0001", "code", "field"))
    enc = encode_chunked(long.select("_key", "text"), "_key", "text", encoder, "vec")
    enc = enc.join(long.select("_key", "code", "field"), "_key").drop("_key")
    if "tasks" in kb.columns:
        t = encode_weighted_tasks(kb.select("code", "tasks"), "code", encoder, "vec").select("code", "vec")
        enc = enc.unionByName(t.withColumn("field", F.lit("task")))
    wide = enc.groupBy("code").pivot("field", list(APP_COLUMNS)).agg(F.first("vec"))
    zero = F.array_repeat(F.lit(0.0), encoder.dim)  # a field that the knowledge base lacks
    return kb.join(wide.select("code", *[F.coalesce(F.col(f), zero).alias(f"vec_{f}") for f in APP_COLUMNS]), "code", "left")
