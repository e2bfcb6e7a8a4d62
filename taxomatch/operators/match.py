"""Top-k matching of queries against a knowledge base (KB).

Score of query q and KB row r::

    final(q, r) = sum_f w_f * cos(q, r_f)                # dense part, six fields
                + bm25_weight * bm25(q, r) / max_r bm25  # optional lexical part
                + title_boost * |words(q) & words(r)|    # optional title boost

Ranking is by ``final`` descending, ties by KB ``code`` ascending. The result
holds, per query, the top-k codes, titles, final scores and unboosted dense
scores (``raw``), so all three reference variants can be formatted from it.

Physical plan. There is no cross join and no pair table:

* **prepare** (once per KB, reusable across calls and micro-batches) - the six
  normalised fields are folded with their weights into one vector per KB row
  JVM-side (one dot product per pair), the result is checkpointed into the
  shared checkpoint folder and size-checked.
* **broadcast path** - under ``broadcast_limit_bytes`` the prepared KB is
  collected once and broadcast. Queries are scored in Arrow batches by
  ``mapInArrow``; only the top-k per query leaves the task. A caller whose
  queries come in few partitions spreads them at the source
  (``session.spread_input``) or passes ``partitions``.
* **blocked path** - for a larger KB, KB rows are hashed into ``B`` blocks and
  queries into ``Q`` buckets (sized so one co-group side holds about
  ``block_bytes`` of vectors); both sides are replicated only across the
  other side's block ids and co-grouped on (kb_block, q_bucket). Each group
  scores a bounded slab and keeps its top-k; a final group-by on the query
  merges the ``B*k`` candidates. BM25 takes a first pass for the per-query
  maximum over the whole KB.

Inside a task the dense part is one matrix product per sub-batch (capped at
``max_cells`` scores); the title boost and BM25 are sparse postings (term ->
KB rows) accumulated with one ``bincount``; top-k is an ``argpartition`` with
an exact tie repair (lowest code wins).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.functions.vectors import FIELDS, TUNED_WEIGHTS, WEIGHT_NAMES, normalize, scale
from taxomatch.session import ensure_checkpoint_dir, reliable_checkpoint, ship_package

RESULT_FIELDS = [
    T.StructField("codes", T.ArrayType(T.StringType())),
    T.StructField("titles", T.ArrayType(T.StringType())),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("raw_scores", T.ArrayType(T.DoubleType())),
]


@dataclass(frozen=True)
class MatchConfig:
    weights: dict = field(default_factory=lambda: dict(TUNED_WEIGHTS))
    k: int = 3
    title_boost: float = 0.0          # 0.03 in the eval and app variants
    bm25_weight: float = 0.0          # the eval variant computes BM25 with weight 0
    broadcast_limit_bytes: int = 256 << 20
    kb_block_rows: int = 20_000       # blocked path: KB rows per block (at most)
    query_block_rows: int = 200_000   # blocked path: query rows per bucket (at most)
    block_bytes: int = 64 << 20       # blocked path: vector bytes per side of a co-group
    max_cells: int = 1 << 23          # scores held at once inside a task
    force_blocked: bool = False

    def field_weights(self) -> np.ndarray:
        return np.array([float(self.weights.get(n, 0.0)) for n in WEIGHT_NAMES], dtype=np.float64)


# Scores equal to 12 decimals rank as ties (then by code).
RANK_DECIMALS = 12

PRODUCTION = MatchConfig()
EVAL = MatchConfig(title_boost=0.03)


# ---------------------------------------------------------------------------
# In-task scoring (numpy on one Arrow batch); shared by both physical paths.
# ---------------------------------------------------------------------------

def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)
    return out


def _stack(vectors, dim: int) -> np.ndarray:
    """Rows of a matrix; a missing or empty vector is zero, any other width
    than ``dim`` is an error."""
    if len(vectors) and all(v is not None and len(v) == dim for v in vectors):
        return np.concatenate(vectors).astype(np.float64, copy=False).reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), dtype=np.float64)
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            if len(v) != dim:
                raise ValueError(f"a vector has {len(v)} components, the knowledge base has {dim}")
            out[i] = v
    return out


def vec_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    """``_stack`` of an Arrow column of arrays or of sparse vectors (``encode.SPARSE``)."""
    n = len(vectors)
    if pa.types.is_struct(vectors.type):
        width, pos, value = vectors.flatten()  # null where the vector is
        other = pc.unique(width.drop_null()).to_pylist()
        if other not in ([], [dim]):
            raise ValueError(f"vectors have {other} components, the knowledge base has {dim}")
        out = np.zeros((n, dim), dtype=np.float64)
        lens = pc.fill_null(pos.value_lengths(), 0).to_numpy(zero_copy_only=False)
        out[np.repeat(np.arange(n), lens), pos.flatten().to_numpy()] = value.flatten().to_numpy()
        return out
    lens = pc.fill_null(vectors.value_lengths(), 0).to_numpy(zero_copy_only=False)
    wrong = lens[(lens != dim) & (lens != 0)]
    if len(wrong):
        raise ValueError(f"a vector has {wrong[0]} components, the knowledge base has {dim}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    if len(flat) == n:
        return flat
    out = np.zeros((n, dim), dtype=np.float64)
    out[lens > 0] = flat
    return out


def dense_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    """``df`` with sparse vectors, if it has such, as arrays (null: null)."""
    if not isinstance(df.schema[vec].dataType, T.StructType) if vec in df.columns else True:
        return df
    ship_package(df.sparkSession)

    @F.arrow_udf("array<double>")
    def dense(v: pa.Array) -> pa.Array:
        width = pc.unique(v.flatten()[0].drop_null()).to_pylist()
        if len(width) > 1:
            raise ValueError(f"vectors have {width} components")
        out, known = vec_rows(v, width[0] if width else 0), v.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(known * out.shape[1])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out[known].ravel()), mask=pa.array(~known))

    return df.withColumn(vec, dense(vec))


def typed_empty(schema: T.StructType) -> pd.DataFrame:
    """No rows, with column types that convert to ``schema``."""
    kinds = {T.LongType: "int64", T.IntegerType: "int32", T.DoubleType: "float64"}
    return pd.DataFrame({f.name: pd.Series([], dtype=kinds.get(type(f.dataType), "object")) for f in schema.fields})


class KbSlab:
    """A KB slice held in memory: codes sorted ascending, fused matrix and
    sparse lexical term matrices."""

    def __init__(self, pdf: pd.DataFrame, cfg: MatchConfig, dim: int, prefused: bool = True):
        pdf = pdf.sort_values("code", kind="stable").reset_index(drop=True)
        self.codes = pdf["code"].astype(object).to_numpy()
        self.titles = pdf["title"].astype(object).to_numpy()
        self.n = len(pdf)
        w = cfg.field_weights()
        self.fused = None
        if prefused:
            # ``vec_fused`` already holds sum_f w_f * unit(v_f) (see prepare_kb)
            if dim > 0 and "vec_fused" in pdf.columns:
                self.fused = _stack(pdf["vec_fused"].tolist(), dim)
        elif dim > 0 and np.any(w != 0):
            fused = np.zeros((self.n, dim), dtype=np.float64)
            for f, wf in zip(FIELDS, w):
                c = f"vec_{f}"
                if wf != 0 and c in pdf.columns:
                    fused += wf * _unit_rows(_stack(pdf[c].tolist(), dim))
            self.fused = fused
        self.title_vocab, self.title_m = None, None
        if cfg.title_boost and "title_words" in pdf.columns:
            self.title_vocab, self.title_m = self._term_matrix(
                [[(t, 1.0) for t in (ws if ws is not None else [])] for ws in pdf["title_words"]])
        self.bm25_vocab, self.bm25_m = None, None
        if cfg.bm25_weight and "bm25_terms" in pdf.columns:
            self.bm25_vocab, self.bm25_m = self._term_matrix(
                [[(t["token"], t["weight"]) for t in (ts if ts is not None else [])] for ts in pdf["bm25_terms"]])

    def _term_matrix(self, rows):
        """Sparse postings (CSR by term): vocab term -> KB columns and weights.
        Memory is the number of (term, KB row) pairs, never vocab x KB."""
        vocab: dict[str, int] = {}
        t_ids, cols, vals = [], [], []
        for j, terms in enumerate(rows):
            for t, wt in terms:
                t_ids.append(vocab.setdefault(t, len(vocab)))
                cols.append(j)
                vals.append(float(wt))
        t_ids = np.asarray(t_ids, dtype=np.int64)
        order = np.argsort(t_ids, kind="stable")
        indptr = np.zeros(len(vocab) + 1, dtype=np.int64)
        np.add.at(indptr, t_ids + 1, 1)
        return vocab, (np.cumsum(indptr), np.asarray(cols, dtype=np.int64)[order], np.asarray(vals, dtype=np.float64)[order])

    def _sparse_scores(self, lists, vocab, postings, distinct: bool) -> np.ndarray:
        """(rows x n_kb) sum over each query's terms of the term's KB weights,
        via the postings and one ``bincount`` (no dense term matrix). ``lists``:
        an Arrow column, or one of pandas."""
        lists = lists if isinstance(lists, pa.Array) else pa.array(lists, type=pa.list_(pa.string()))
        out = np.zeros((len(lists), self.n), dtype=np.float64)
        lens = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        if lens.sum() == 0 or not vocab or self.n == 0:
            return out
        ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(list(vocab), type=pa.string())), -1).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lists)), lens)
        ok = ids >= 0
        rows, terms = rows[ok], ids[ok].astype(np.int64)
        if distinct:
            key = np.unique(rows * len(vocab) + terms)
            rows, terms = key // len(vocab), key % len(vocab)
        indptr, cols, vals = postings
        starts, plen = indptr[terms], indptr[terms + 1] - indptr[terms]
        total = int(plen.sum())
        if total == 0:
            return out
        pos = np.repeat(starts - (np.cumsum(plen) - plen), plen) + np.arange(total)
        flat_idx = np.repeat(rows, plen) * self.n + cols[pos]
        out += np.bincount(flat_idx, weights=vals[pos], minlength=len(lists) * self.n).reshape(len(lists), self.n)
        return out

    def score(self, q, cfg: MatchConfig, dim: int):
        """Return (final, raw) score matrices of shape (rows, n_kb) of an Arrow
        batch or a pandas one."""
        rows = len(q)
        arrow = isinstance(q, pa.RecordBatch)
        names = q.schema.names if arrow else q.columns
        raw = np.zeros((rows, self.n), dtype=np.float64)
        if self.fused is not None and "vec" in names:
            m = vec_rows(q.column("vec"), dim) if arrow else _stack(q["vec"].tolist(), dim)
            raw = _unit_rows(m) @ self.fused.T
        final = raw.copy()
        if self.bm25_m is not None and "tokens" in names:
            s = self.bm25_raw(q)
            if "_bm25_max" in names:  # blocked path: max over the whole KB
                mx = q["_bm25_max"].fillna(0.0).to_numpy(dtype=np.float64)[:, None]
            else:
                mx = s.max(axis=1, keepdims=True) if self.n else np.zeros((rows, 1))
            s = np.where(mx > 0, s / np.where(mx > 0, mx, 1.0), s)
            final = final + cfg.bm25_weight * s
        if self.title_m is not None and "title_words" in names:
            ov = self._sparse_scores(q.column("title_words") if arrow else q["title_words"].tolist(), self.title_vocab, self.title_m, distinct=True)
            final = final + cfg.title_boost * ov
        return final, raw

    def bm25_raw(self, q) -> np.ndarray:
        return self._sparse_scores(q.column("tokens") if isinstance(q, pa.RecordBatch) else q["tokens"].tolist(), self.bm25_vocab, self.bm25_m, distinct=False)

    def topk(self, final: np.ndarray, k: int) -> np.ndarray:
        """Indices of the k best columns per row: score desc, then code asc
        (columns are in code order, so a stable sort keeps the lower index).
        Scores are compared at 12 decimals (``RANK_DECIMALS``): sums that are
        equal up to float summation order are ties, so the order does not
        depend on partitioning or on the engine."""
        final = np.round(final, RANK_DECIMALS)
        k = min(k, self.n)
        if k == 0:
            return np.zeros((final.shape[0], 0), dtype=np.int64)
        if k <= 8 and np.isfinite(final).all():  # one pass a place; the first of equal scores is the lowest code
            out = np.empty((len(final), k), dtype=np.int64)
            rows = np.arange(len(final))
            for j in range(k):
                out[:, j] = final.argmax(axis=1)
                final[rows, out[:, j]] = -np.inf
            return out
        if self.n <= 512:
            return np.argsort(-final, axis=1, kind="stable")[:, :k]
        rows = np.arange(final.shape[0])[:, None]
        part = np.argpartition(-final, k - 1, axis=1)[:, :k]
        vals = final[rows, part]
        kth = vals.min(axis=1)
        # order the k picks by (score desc, column asc)
        order = np.lexsort((part, -vals), axis=1)
        out = np.take_along_axis(part, order, 1)
        # rows with ties at the k-th value may need a lower column than argpartition picked
        tied = np.flatnonzero((final >= kth[:, None]).sum(axis=1) > k)
        for i in tied:
            cand = np.flatnonzero(final[i] >= kth[i])
            out[i] = cand[np.argsort(-final[i, cand], kind="stable")][:k]
        return out


def _score_rows(q, slab: KbSlab, cfg: MatchConfig, dim: int):
    """Yield per-query top-k arrays for one batch, in sub-batches so the score
    matrix stays under ``max_cells``."""
    step = max(1, cfg.max_cells // max(slab.n, 1))
    for start in range(0, len(q), step):
        part = q.slice(start, step) if isinstance(q, pa.RecordBatch) else q.iloc[start:start + step]
        final, raw = slab.score(part, cfg, dim)
        idx = slab.topk(final, cfg.k)
        if idx.size:
            yield part, idx, np.take_along_axis(final, idx, 1), np.take_along_axis(raw, idx, 1)
        else:
            yield part, idx, np.zeros(idx.shape), np.zeros(idx.shape)


# ---------------------------------------------------------------------------
# Public entry points
# ---------------------------------------------------------------------------

def prepare_kb(kb: DataFrame, cfg: MatchConfig, fuse: bool = True) -> DataFrame:
    """Keep only what scoring needs. With ``fuse`` the six fields are folded
    into one weighted sum of unit vectors JVM-side (R1), so the broadcast holds
    one matrix, not six."""
    cols = ["code", "title"]
    vec_cols = [f"vec_{f}" for f in FIELDS if f"vec_{f}" in kb.columns]
    w = cfg.field_weights()
    out = kb
    if fuse and vec_cols:
        terms = None
        for f, wf in zip(FIELDS, w):
            c = f"vec_{f}"
            if wf == 0 or c not in kb.columns:
                continue
            t = scale(normalize(F.col(c).cast("array<double>")), float(wf))
            # a missing field vector counts as zero
            terms = t if terms is None else F.coalesce(F.zip_with(terms, t, lambda a, b: a + b), terms, t)
        if terms is not None:
            out = out.withColumn("vec_fused", terms)
            cols.append("vec_fused")
    else:
        cols += vec_cols
    if cfg.title_boost and "title_words" in kb.columns:
        cols.append("title_words")
    if cfg.bm25_weight and "bm25_terms" in kb.columns:
        cols.append("bm25_terms")
    return out.select(*cols)


def kb_profile(kb: DataFrame) -> dict:
    """One small aggregate job: row count, vector width, lexical sizes."""
    aggs = [F.count(F.lit(1)).alias("n")]
    vcols = [c for c in kb.columns if c.startswith("vec_")]
    aggs.append(F.greatest(F.lit(0), *[F.max(F.size(c)) for c in vcols]).alias("dim") if vcols else F.lit(0).alias("dim"))
    aggs.append(F.coalesce(F.sum(F.length("code") + F.length("title")), F.lit(0)).alias("chars"))
    for c in ("title_words", "bm25_terms"):
        aggs.append((F.sum(F.size(c)) if c in kb.columns else F.lit(0)).alias(c))
    r = kb.agg(*aggs).collect()[0]
    return {"n": int(r["n"]), "dim": int(r["dim"] or 0), "lex": int((r["title_words"] or 0) + (r["bm25_terms"] or 0)),
            "vec_cols": len(vcols), "chars": int(r["chars"])}


@dataclass
class PreparedKb:
    """A KB made ready for scoring once and reusable across many ``match``
    calls (e.g. every micro-batch of a stream): either a broadcast slab or,
    over the size limit, the checkpointed KB frame for the blocked path."""
    cfg: MatchConfig
    mode: str
    dim: int
    n: int
    broadcast: object = None
    frame: DataFrame | None = None

    def close(self) -> None:
        """Release the broadcast copy, once no result is to be read any more."""
        if self.broadcast is not None:
            self.broadcast.destroy()


def prepare(kb: DataFrame, cfg: MatchConfig = PRODUCTION) -> PreparedKb:
    """Size-check the KB and prepare it: fused vectors JVM-side, then either
    one collect + broadcast (under ``broadcast_limit_bytes``) or a checkpoint
    of the prepared frame in the shared checkpoint folder (blocked path)."""
    spark = kb.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    # the size check and the collect read one reliable copy of the KB
    small = reliable_checkpoint(prepare_kb(kb, cfg, fuse=True))
    prof = kb_profile(small)
    # a row's matrix and Python objects, its titles, and a Python object per lexical term
    est = prof["n"] * (prof["dim"] * 8 * max(prof["vec_cols"], 1) + 400) + prof["chars"] * 4 + prof["lex"] * 200
    if not cfg.force_blocked and est <= cfg.broadcast_limit_bytes:
        slab = KbSlab(small.toPandas(), cfg, prof["dim"])  # bounded: size checked just above
        return PreparedKb(cfg, "broadcast", prof["dim"], prof["n"], spark.sparkContext.broadcast(slab))
    return PreparedKb(cfg, "blocked", prof["dim"], prof["n"], frame=small)


def match(queries: DataFrame, kb, cfg: MatchConfig | None = None,
          query_id: str = "query_id", partitions: int | None = None) -> DataFrame:
    """Top-k matches per query.

    ``queries`` needs ``query_id`` and any of ``vec`` (array<double>, or sparse),
    ``tokens`` (array<string>, BM25), ``title_words`` (array<string>, boost).
    ``kb`` is a ``PreparedKb`` or a DataFrame with ``code``, ``title`` and any
    of ``vec_<field>``, ``title_words``, ``bm25_terms``
    (array<struct<token,weight>>). Other query columns pass through
    unchanged, repeated and null ids included: each query row has its own
    result. Result: query columns + codes, titles, scores, raw_scores; fewer
    than k knowledge base rows give shorter lists, none gives empty ones.
    """
    ship_package(queries.sparkSession)
    if partitions:
        queries = queries.repartition(partitions)
    prepared = kb if isinstance(kb, PreparedKb) else prepare(kb, cfg or PRODUCTION)
    if prepared.mode == "broadcast":
        return _match_broadcast(queries, prepared, query_id)
    return _match_blocked(queries, prepared, query_id)


def _query_inputs(queries: DataFrame) -> list[str]:
    return [c for c in ("vec", "tokens", "title_words") if c in queries.columns]


def _match_broadcast(queries: DataFrame, prepared: PreparedKb, query_id: str) -> DataFrame:
    bc, cfg, dim = prepared.broadcast, prepared.cfg, prepared.dim
    inputs = _query_inputs(queries)
    keep = [c for c in queries.columns if c not in inputs]
    schema = T.StructType([queries.schema[c] for c in keep] + RESULT_FIELDS)

    def run(batches):
        s = bc.value
        codes, titles = (pa.array(x, type=pa.string()) for x in (s.codes, s.titles))
        for batch in batches:
            for part, idx, fin, raw in _score_rows(batch, s, cfg, dim):
                ends = pa.array(np.arange(len(part) + 1) * idx.shape[1], pa.int32())
                at = pa.array(idx.ravel())
                found = [codes.take(at), titles.take(at), pa.array(fin.ravel()), pa.array(raw.ravel())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.ListArray.from_arrays(ends, x) for x in found], schema.names)

    return queries.select(*keep, *inputs).mapInArrow(run, schema)


def block_rows(limit_rows: int, block_bytes: int, dim: int, floor: int = 1) -> int:
    """Rows per block so one side of a co-group holds about ``block_bytes`` of
    float64 vectors (a co-group is materialised in one Python worker)."""
    return max(1, min(limit_rows, max(floor, block_bytes // max(8 * max(dim, 1), 1))))


def _blocks(queries: DataFrame, kb: DataFrame, cols: list[str], cfg: MatchConfig, n_kb: int, query_id: str,
            dim: int = 0):
    """Both sides keyed by (kb_block, q_bucket): queries replicated over KB
    blocks, KB rows over query buckets. Block sizes follow the vector width."""
    kb_rows = block_rows(cfg.kb_block_rows, cfg.block_bytes, dim)
    q_rows = block_rows(cfg.query_block_rows, cfg.block_bytes, dim, floor=1000)
    n_kb_blocks = max(1, math.ceil(n_kb / kb_rows))
    n_q_buckets = max(1, math.ceil(queries.count() / q_rows))
    q = (queries.select(query_id, *cols)
         .withColumn("q_bucket", F.pmod(F.xxhash64(query_id), F.lit(n_q_buckets)).cast("int"))
         .withColumn("kb_block", F.explode(F.sequence(F.lit(0), F.lit(n_kb_blocks - 1)))))
    k = (kb.withColumn("kb_block", F.pmod(F.xxhash64("code"), F.lit(n_kb_blocks)).cast("int"))
         .withColumn("q_bucket", F.explode(F.sequence(F.lit(0), F.lit(n_q_buckets - 1)))))
    return q.groupBy("kb_block", "q_bucket").cogroup(k.groupBy("kb_block", "q_bucket"))


def _bm25_max(queries: DataFrame, prepared: PreparedKb, query_id: str) -> DataFrame:
    """Pass 1 of BM25 on the blocked path: per query, the largest raw BM25
    score over the whole KB (block maxima, then a max per query)."""
    cfg, dim = prepared.cfg, prepared.dim
    schema = T.StructType([queries.schema[query_id], T.StructField("_bm25_max", T.DoubleType())])

    def block_max(qpdf: pd.DataFrame, kpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or kpdf.empty:
            return typed_empty(schema)
        slab = KbSlab(kpdf, cfg, dim)
        if slab.bm25_m is None:
            return pd.DataFrame({query_id: qpdf[query_id].to_numpy(), "_bm25_max": np.zeros(len(qpdf))})
        return pd.DataFrame({query_id: qpdf[query_id].to_numpy(), "_bm25_max": slab.bm25_raw(qpdf).max(axis=1)})

    g = _blocks(queries, prepared.frame, ["tokens"], cfg, prepared.n, query_id, prepared.dim)
    return g.applyInPandas(block_max, schema).groupBy(query_id).agg(F.max("_bm25_max").alias("_bm25_max"))


def _match_blocked(queries: DataFrame, prepared: PreparedKb, payload_id: str) -> DataFrame:
    cfg, dim = prepared.cfg, prepared.dim
    # a number of its own for each row: ids may repeat or be null. Written once,
    # so the number is the same for the candidates and for the final join
    query_id = "_query_row"
    queries = reliable_checkpoint(dense_vectors(queries).withColumn(query_id, F.monotonically_increasing_id()))
    inputs = _query_inputs(queries)
    scored = queries.select(query_id, *inputs)
    if cfg.bm25_weight and "tokens" in inputs and "bm25_terms" in prepared.frame.columns:
        scored = scored.join(_bm25_max(scored, prepared, query_id), query_id, "left")
        inputs = inputs + ["_bm25_max"]
    grouped = _blocks(scored, prepared.frame, inputs, cfg, prepared.n, query_id, prepared.dim)
    cand_schema = T.StructType([
        queries.schema[query_id],
        T.StructField("code", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("raw", T.DoubleType()),
    ])

    def block(qpdf: pd.DataFrame, kpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or kpdf.empty:
            return typed_empty(cand_schema)
        slab = KbSlab(kpdf, cfg, dim)
        outs = []
        for part, idx, fin, raw in _score_rows(qpdf, slab, cfg, dim):
            kk = idx.shape[1]
            outs.append(pd.DataFrame({
                query_id: np.repeat(part[query_id].to_numpy(), kk),
                "code": slab.codes[idx].ravel(), "title": slab.titles[idx].ravel(),
                "score": fin.ravel(), "raw": raw.ravel(),
            }))
        return pd.concat(outs, ignore_index=True) if outs else typed_empty(cand_schema)

    cands = grouped.applyInPandas(block, cand_schema)
    ranked = (cands.groupBy(query_id)
              .agg(F.slice(F.array_sort(F.collect_list(
                  F.struct((-F.round("score", RANK_DECIMALS)).alias("neg"), "code", "title", "score", "raw"))),
                  1, cfg.k).alias("top"))
              .select(query_id,
                      F.col("top.code").alias("codes"), F.col("top.title").alias("titles"),
                      F.col("top.score").alias("scores"), F.col("top.raw").alias("raw_scores")))
    rest = queries.drop(*_query_inputs(queries))
    out = rest.join(ranked, query_id, "left").drop(query_id)
    return out.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in RESULT_FIELDS})


# ---------------------------------------------------------------------------
# Output formats
# ---------------------------------------------------------------------------

def to_long(result: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per (query, rank): rank, code, title, score, raw_score."""
    z = F.arrays_zip("codes", "titles", "scores", "raw_scores")
    return (result.select(query_id, F.posexplode(z).alias("pos", "m"))
            .select(query_id, (F.col("pos") + 1).alias("rank"), F.col("m.codes").alias("code"),
                    F.col("m.titles").alias("title"), F.col("m.scores").alias("score"),
                    F.col("m.raw_scores").alias("raw_score")))


def to_wide(result: DataFrame, variant: str = "production", k: int = 3) -> DataFrame:
    """Reference output columns; narrow (no shuffle).

    production: Match_i_SOC_Code, Match_i_Title, Match_i_Score = final*100, 2 dp.
    eval: Machine_SOC_Code, Machine_Title, Machine_Confidence = unboosted score
    of the winner *100, 2 dp; Top_Codes (the k codes, for Correct_Top3).
    app: Matched_SOC_Code, Matched_Title, Confidence_% = unboosted *100, 1 dp;
    TopN_SOC/Title/Confidence = boosted score *100, 1 dp.
    """
    base = [c for c in result.columns if c not in ("codes", "titles", "scores", "raw_scores")]
    e = lambda c, i: F.try_element_at(c, F.lit(i))  # noqa: E731  null beyond a short list
    if variant == "production":
        cols = []
        for i in range(1, k + 1):
            cols += [e("codes", i).alias(f"Match_{i}_SOC_Code"), e("titles", i).alias(f"Match_{i}_Title"),
                     F.round(e("scores", i) * 100, 2).alias(f"Match_{i}_Score")]
        return result.select(*base, *cols)
    if variant == "eval":
        return result.select(*base, e("codes", 1).alias("Machine_SOC_Code"), e("titles", 1).alias("Machine_Title"),
                             F.round(e("raw_scores", 1) * 100, 2).alias("Machine_Confidence"),
                             F.col("codes").alias("Top_Codes"))
    if variant == "app":
        cols = [e("codes", 1).alias("Matched_SOC_Code"), e("titles", 1).alias("Matched_Title"),
                F.round(e("raw_scores", 1) * 100, 1).alias("Confidence_%")]
        for i in range(2, k + 1):
            cols += [e("codes", i).alias(f"Top{i}_SOC"), e("titles", i).alias(f"Top{i}_Title"),
                     F.round(e("scores", i) * 100, 1).alias(f"Top{i}_Confidence")]
        return result.select(*base, *cols)
    raise ValueError(f"unknown variant {variant!r}")


def match_one(spark, kb: DataFrame, title: str, description: str, encode, cfg: MatchConfig = PRODUCTION):
    """Single lookup: a batch of one. ``encode`` maps a DataFrame with
    ``text`` to one with ``vec``. A blank title is refused."""
    if not title or not str(title).strip():
        raise ValueError("title is blank")
    from taxomatch.functions.text import query_text, title_words

    q = spark.createDataFrame([(0, title, description or "")], "query_id long, title string, description string")
    q = q.withColumn("text", query_text("title", "description"))
    q = encode(q).withColumn("title_words", title_words("title"))
    return match(q.select("query_id", "title", "vec", "title_words"), kb, cfg)
