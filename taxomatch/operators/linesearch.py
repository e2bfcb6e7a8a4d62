"""Exact line search of field weights.

One field's share ``s`` of the weights runs from 0 to 1 while the others keep
their proportions. Along it every knowledge-base row's score is a line,
``(1 - s) * rest + s * field``, so a query's true code is above another row on
one side of one point, and on top on one interval: the intersection of those
half-lines. Its ends are counted +1 and -1; sums of the counts in the order of
the points give the number of hits on every piece of the way at once, and the
best piece is known exactly, not sampled.

Points are whole multiples of 1e-9, so equal points of any number of queries are
one row before the first shuffle, and a bucket of 2^20 points has a bounded
number of rows however the points fall. Pieces shorter than ``MIN_PIECE``
points are passed over: no weight inside them is safe from rounding.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.functions.vectors import FIELDS, cosine
from taxomatch.operators.match import _stack, _unit_rows, block_rows, dense_vectors, typed_empty, vec_rows
from taxomatch.operators.prefix import written

GRID = 1_000_000_000       # points between share 0 and share 1
BUCKET_BITS = 20           # 2^20 points are summed by one window group
MIN_PIECE = 10_000         # points
STEP = 1_000               # a step ends on a multiple of it
TIE = 5e-13                # scores nearer than this are equal, as in the 12 decimals of the ranking

EVENTS = "field int, point long, delta long"
BOUNDS = "row long, field int, lo double, hi double, never boolean"


def rest_share(weights, field: int) -> float:
    """Sum of the weights other than ``field``'s."""
    return float(sum(w for g, w in enumerate(weights) if g != field))


def moved(weights, field: int, share: float) -> tuple[float, ...]:
    """``weights`` with ``share`` for ``field``, the others in proportion."""
    rest = rest_share(weights, field)
    return tuple(share if g == field else (1.0 - share) * w / rest for g, w in enumerate(weights))


def intervals(sims: np.ndarray, own: np.ndarray, lower: np.ndarray, self_: np.ndarray, weights) -> list[tuple]:
    """``(field, lo, hi, never)`` arrays over rows, for each field that has a
    rest. ``sims``: (fields, rows, items); ``own``: (fields, rows), the true
    item's; ``lower``: items that win ties against the true one; ``self_``: the
    true item itself, which bounds nothing."""
    out = []
    for f in range(len(weights)):
        rest = rest_share(weights, f)
        if rest <= 0:
            continue
        others = np.array([0.0 if g == f else w / rest for g, w in enumerate(weights)])
        a0 = (others @ own)[:, None] - np.tensordot(others, sims, axes=1)  # lead at share 0
        a1 = own[f][:, None] - sims[f]                                     # lead at share 1
        a0[np.abs(a0) < TIE] = 0.0
        a1[np.abs(a1) < TIE] = 0.0
        tied = (a0 == 0) & (a1 == 0)
        behind = (a0 <= 0) & (a1 <= 0) & ~tied
        never = ((behind | (tied & lower)) & ~self_).any(axis=1)
        cut = np.divide(a0, a0 - a1, out=np.zeros_like(a0), where=a0 != a1)
        lo = np.where((a0 < 0) & (a1 > 0) & ~self_, cut, 0.0).max(axis=1, initial=0.0)
        hi = np.where((a0 > 0) & (a1 < 0) & ~self_, cut, 1.0).min(axis=1, initial=1.0)
        out.append((f, lo, hi, never))
    return out


def _points(x: np.ndarray) -> np.ndarray:
    return np.floor(x * GRID + 0.5).astype(np.int64)


def _events_frame(parts: list[tuple]) -> pd.DataFrame:
    """Counts at distinct points of (field, lo, hi, never) arrays."""
    field, point, delta = [], [], []
    for f, lo, hi, never in parts:
        a, b = _points(lo), _points(hi)
        live = ~never & (a < b)
        field.append(np.full(2 * int(live.sum()), f, dtype=np.int32))
        point.append(np.concatenate([a[live], b[live]]))
        delta.append(np.concatenate([np.ones(int(live.sum()), dtype=np.int64), np.full(int(live.sum()), -1, dtype=np.int64)]))
    if not field:
        return pd.DataFrame({"field": np.zeros(0, np.int32), "point": np.zeros(0, np.int64), "delta": np.zeros(0, np.int64)})
    pdf = pd.DataFrame({"field": np.concatenate(field), "point": np.concatenate(point), "delta": np.concatenate(delta)})
    return pdf.groupby(["field", "point"], as_index=False)["delta"].sum().astype({"field": "int32"})


def true_places(codes: pa.Array, slab) -> tuple[np.ndarray, pa.Array]:
    """(places of the true codes in the knowledge base, the batch's rows whose
    true code is there)."""
    at = pc.index_in(codes, value_set=pa.array(slab.codes, type=pa.string()), skip_nulls=True)
    return at.drop_null().to_numpy().astype(np.int64), pa.array(np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)))


def events_broadcast(queries: DataFrame, slab, weights, truth: str, dim: int, max_cells: int) -> DataFrame:
    """Events of queries against a broadcast knowledge base (``slab``: a handle
    on a FieldSlab, codes ascending)."""
    weights = tuple(weights)

    def run(batches):
        s = slab.value
        step = max(1, max_cells // max(s.n * 2 * len(FIELDS), 1))
        place = np.arange(s.n)
        for batch in batches:
            t, known = true_places(batch.column(truth), s)
            for a in range(0, len(known), step):
                at = t[a:a + step]
                q = _unit_rows(vec_rows(batch.column("vec").take(known.slice(a, step)), dim))
                f, n, d = s.fields.shape
                sims = (q @ s.fields.reshape(f * n, d).T).reshape(len(q), f, n).transpose(1, 0, 2)
                own = sims[:, np.arange(len(at)), at]
                found = _events_frame(intervals(sims, own, place[None, :] < at[:, None], place[None, :] == at[:, None], weights))
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return queries.select("vec", F.col(truth).cast("string").alias(truth)).mapInArrow(run, EVENTS)


def events_blocked(queries: DataFrame, kb: DataFrame, weights, truth: str, n_kb: int, dim: int, slab_of, max_cells: int,
                   kb_block_rows: int, query_block_rows: int) -> DataFrame:
    """The same for a knowledge base of any size: each query's own six cosines
    are joined to it, every block of items gives bounds, and a query's bounds
    meet by maximum and minimum."""
    weights = tuple(weights)
    names = [c for c in kb.columns if c != "code"]
    mine = kb.select(F.col("code").alias("_code"), *[F.col(c).alias(f"_own_{c}") for c in names])
    q = dense_vectors(queries).select("vec", F.col(truth).alias("_code")).join(mine, "_code")
    vec = F.coalesce(F.col("vec"), F.array().cast("array<double>"))
    own = [F.coalesce(cosine(vec, F.col(f"_own_vec_{f}")), F.lit(0.0)) if f"vec_{f}" in names else F.lit(0.0) for f in FIELDS]
    # rows are told apart by a number of their own: ids may repeat or be null
    q = written(q.select("vec", "_code", F.array(*own).alias("own"), F.monotonically_increasing_id().alias("row")), "line-rows")
    n_b = max(1, math.ceil(n_kb / block_rows(kb_block_rows, 64 << 20, dim * len(FIELDS))))
    n_q = max(1, math.ceil(q.count() / block_rows(query_block_rows, 64 << 20, dim, floor=1000)))
    qb = (q.withColumn("q_bucket", F.pmod(F.xxhash64("row"), F.lit(n_q)).cast("int"))
          .withColumn("kb_block", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1)))))
    kbb = (kb.withColumn("kb_block", F.pmod(F.xxhash64("code"), F.lit(n_b)).cast("int"))
           .withColumn("q_bucket", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))))

    def block(qpdf: pd.DataFrame, kpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or kpdf.empty:
            return typed_empty(_bounds_schema())
        s = slab_of(kpdf, dim)
        step = max(1, max_cells // max(s.n * 2 * len(FIELDS), 1))
        outs = []
        for a in range(0, len(qpdf), step):
            part = qpdf.iloc[a:a + step]
            q = _unit_rows(_stack(part["vec"].tolist(), dim))
            f, n, d = s.fields.shape
            sims = (q @ s.fields.reshape(f * n, d).T).reshape(len(q), f, n).transpose(1, 0, 2)
            code = part["_code"].to_numpy()[:, None]
            for g, lo, hi, never in intervals(sims, np.stack(part["own"].to_numpy()).T, s.codes[None, :] < code, s.codes[None, :] == code, weights):
                outs.append(pd.DataFrame({"row": part["row"].to_numpy(), "field": np.int32(g), "lo": lo, "hi": hi, "never": never}))
        return pd.concat(outs, ignore_index=True) if outs else typed_empty(_bounds_schema())

    b = (qb.groupBy("kb_block", "q_bucket").cogroup(kbb.groupBy("kb_block", "q_bucket")).applyInPandas(block, BOUNDS)
         .groupBy("row", "field").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.max("never").alias("never")))
    at = lambda c: F.floor(F.col(c) * GRID + 0.5).cast("long")
    b = b.where("not never").select("field", at("lo").alias("a"), at("hi").alias("b")).where("a < b")
    return b.select("field", F.inline(F.array(F.struct(F.col("a").alias("point"), F.lit(1).cast("long").alias("delta")),
                                              F.struct(F.col("b").alias("point"), F.lit(-1).cast("long").alias("delta")))))


def _bounds_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("row", T.LongType()), T.StructField("field", T.IntegerType()), T.StructField("lo", T.DoubleType()),
                         T.StructField("hi", T.DoubleType()), T.StructField("never", T.BooleanType())])


def pieces(events: DataFrame) -> DataFrame:
    """``(field, point, length, hits)``: the pieces between neighbouring points
    and the queries that hit on them. Buckets of points are summed first (a few
    thousand at any size), then the points inside each bucket."""
    e = written(events.groupBy("field", "point").agg(F.sum("delta").alias("delta")), "line-points")
    e = e.withColumn("_bucket", F.shiftright("point", BUCKET_BITS))
    buckets = e.groupBy("field", "_bucket").agg(F.sum("delta").alias("_sum"), F.min("point").alias("_first"))
    along = Window.partitionBy("field").orderBy("_bucket")
    buckets = buckets.select("field", "_bucket", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"), F.lead("_first").over(along).alias("_next"))
    inside = Window.partitionBy("field", "_bucket").orderBy("point")
    e = e.join(F.broadcast(buckets), ["field", "_bucket"])  # at most 954 buckets a field
    return e.select("field", "point", (F.coalesce(F.lead("point").over(inside), "_next") - F.col("point")).alias("length"),
                    (F.col("_before") + F.sum("delta").over(inside)).alias("hits")).where("length is not null")


def best_piece(events: DataFrame):
    """``(field, share, hits)`` of the piece with most hits; ties: the longest,
    then the first field, then the first point. None if there is none."""
    r = (pieces(events).where(F.col("length") >= MIN_PIECE)
         .orderBy(F.desc("hits"), F.desc("length"), "field", "point").limit(1).collect())  # one row
    if not r:
        return None
    return r[0]["field"], (r[0]["point"] + r[0]["length"] // 2) // STEP * STEP / GRID, r[0]["hits"]
