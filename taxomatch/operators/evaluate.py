"""Evaluation: per-row comparison with human codes, summary, rank
correlation, accuracy of field weights and a batched weight search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.functions.text import blank_to_empty
from taxomatch.functions.vectors import FIELDS, SEARCH_BASELINE, WEIGHT_NAMES, normalized_weights
from taxomatch.operators import linesearch as line
from taxomatch.operators.match import RANK_DECIMALS, _stack, _unit_rows, block_rows, dense_vectors, typed_empty, vec_rows
from taxomatch.operators.prefix import running_sum, written
from taxomatch.session import reliable_checkpoint, ship_package


def eval_rows(result: DataFrame, occupation: str = "occupation", description: str = "description",
              human_code: str = "onet_soc", human_title: str = "onet_title") -> DataFrame:
    """Nine evaluation columns from a match result. ``Correct`` and
    ``Correct_Top3`` are 1/0, or null when the human code is blank."""
    h = blank_to_empty(human_code)
    has = h != F.lit("")
    top1 = F.try_element_at("codes", F.lit(1))  # null if nothing matched
    return result.select(
        *[c for c in ("query_id",) if c in result.columns],
        F.col(occupation).alias("User_Occupation"),
        F.col(description).alias("User_Description"),
        top1.alias("Machine_SOC_Code"),
        F.try_element_at("titles", F.lit(1)).alias("Machine_Title"),
        F.round(F.try_element_at("raw_scores", F.lit(1)) * 100, 2).alias("Machine_Confidence"),
        h.alias("Human_SOC_Code"),
        blank_to_empty(human_title).alias("Human_Title"),
        F.when(has, (top1 == h).cast("int")).alias("Correct"),
        F.when(has, F.array_contains("codes", h).cast("int")).alias("Correct_Top3"),
    )


def eval_summary(rows: DataFrame) -> DataFrame:
    """One row: n, top-1/top-3 counts and percentages, gap, mean confidence,
    confidence gap between right and wrong rows (a side with no rows counts as
    0), and rows without a human code. n = 0 gives null rates."""
    ok = F.col("Correct").isNotNull()
    conf = F.col("Machine_Confidence")
    c1 = F.sum(F.when(ok, F.col("Correct"))).cast("long")
    c3 = F.sum(F.when(ok, F.col("Correct_Top3"))).cast("long")
    n = F.count_if(ok)
    agg = rows.agg(
        n.alias("n"), F.coalesce(c1, F.lit(0)).alias("top1"), F.coalesce(c3, F.lit(0)).alias("top3"),
        F.avg(F.when(ok, conf)).alias("avg_conf"),
        F.coalesce(F.avg(F.when(ok & (F.col("Correct") == 1), conf)), F.lit(0.0)).alias("_cc"),
        F.coalesce(F.avg(F.when(ok & (F.col("Correct") == 0), conf)), F.lit(0.0)).alias("_cw"),
        F.count_if(~ok).alias("no_code"))
    return agg.select(
        "n", "top1", "top3",
        F.try_divide(F.col("top1") * 100.0, F.col("n")).alias("top1_pct"),
        F.try_divide(F.col("top3") * 100.0, F.col("n")).alias("top3_pct"),
        (F.col("top3") - F.col("top1")).alias("top3_gap"),
        "avg_conf", F.abs(F.col("_cc") - F.col("_cw")).alias("conf_gap"), "no_code")


def _ranks(cells: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): the average rank of each distinct value, by running sums of
    the counts."""
    d = running_sum(cells.groupBy(value).agg(F.sum("_c").alias("_c")), [], [value], "_before", "_c")
    return d.select(value, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out))


def pair_correlation(pairs: DataFrame, pred: str = "cosine", label: str = "score") -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks) of predicted similarity
    against the label, over pairs that have both. Pairs are counted per distinct
    (similarity, label) once; ranks meet those counts, never the pairs."""
    base = pairs.select(F.col(pred).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")).where("_x is not null and _y is not null")
    cells = written(base.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_c")), "correlation-cells")
    n, x, y = cells.agg(F.sum("_c"), F.sum(F.col("_c") * F.col("_x")), F.sum(F.col("_c") * F.col("_y"))).first()
    n, x, y = n or 0, (x or 0.0) / max(n or 0, 1), (y or 0.0) / max(n or 0, 1)
    ranked = cells.join(_ranks(cells, "_x", "_rx"), "_x").join(_ranks(cells, "_y", "_ry"), "_y")

    def corr(a: str, b: str, mean_a: float, mean_b: float) -> Column:
        da, db, c = F.col(a) - F.lit(mean_a), F.col(b) - F.lit(mean_b), F.col("_c")
        return F.try_divide(F.sum(c * da * db), F.sqrt(F.sum(c * da * da)) * F.sqrt(F.sum(c * db * db)))

    middle = (n + 1) / 2
    return ranked.agg(corr("_x", "_y", x, y).alias("cosine_pearson"), corr("_rx", "_ry", middle, middle).alias("cosine_spearman"),
                      F.coalesce(F.sum("_c"), F.lit(0)).alias("pairs"))


# ---------------------------------------------------------------------------
# Field weights: accuracy of many candidate weight vectors in one pass
# ---------------------------------------------------------------------------

class FieldSlab:
    """Per-field unit KB matrices in code order (for per-field cosines)."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        pdf = pdf.sort_values("code", kind="stable").reset_index(drop=True)
        self.codes = pdf["code"].astype(object).to_numpy()
        self.index = {c: i for i, c in enumerate(self.codes)}
        self.n = len(pdf)
        self.fields = np.stack([
            _unit_rows(_stack(pdf[f"vec_{f}"].tolist(), dim)) if f"vec_{f}" in pdf.columns
            else np.zeros((self.n, dim)) for f in FIELDS])  # (6, n_kb, dim)


def one_per_code(kb: DataFrame) -> DataFrame:
    """One row per code; of several the largest in the order of their vectors,
    so both physical paths take the same one."""
    vcols = [f"vec_{f}" for f in FIELDS if f"vec_{f}" in kb.columns]
    return kb.groupBy("code").agg(F.max(F.struct(*vcols)).alias("v")).select("code", *[f"v.{c}" for c in vcols])


def _kb_fields(kb: DataFrame, limit_bytes: int, force_blocked: bool = False):
    """Profile the KB (one job) and, under the limit, collect it as a slab."""
    kb = one_per_code(kb)
    vcols = [c for c in kb.columns if c != "code"]
    prof = kb.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(0), *[F.max(F.size(c)) for c in vcols]).alias("dim")).collect()[0]
    n, dim = int(prof["n"]), int(prof["dim"] or 0)
    if force_blocked or n * dim * 8 * len(FIELDS) > limit_bytes:
        return None, n, dim
    return FieldSlab(kb.toPandas(), dim), n, dim  # bounded: checked above


def _per_field(q: np.ndarray, slab: "FieldSlab") -> np.ndarray:
    """(6, rows, n_kb) cosines from one matrix product over all fields."""
    f, n, dim = slab.fields.shape
    return (q @ slab.fields.reshape(f * n, dim).T).reshape(len(q), f, n).transpose(1, 0, 2)


def _candidate_frame(spark, cand):
    return spark.createDataFrame([(i, *map(float, cand[i])) for i in range(len(cand))],
                                 ["candidate"] + [f"w_{f}" for f in FIELDS])


def weight_accuracy(queries: DataFrame, kb: DataFrame, candidates, truth: str = "truth_code",
                    query_id: str = "query_id", limit_bytes: int = 256 << 20, max_cells: int = 1 << 22,
                    force_blocked: bool = False, kb_block_rows: int = 20_000,
                    query_block_rows: int = 200_000, prepared=None) -> DataFrame:
    """Top-1 accuracy of each candidate weight vector (normalised to
    ``abs(w)/sum(abs(w))``). Queries whose true code is not in the KB are
    dropped. Argmax takes the lowest code on ties.

    Under ``limit_bytes`` the per-field KB matrices are broadcast; each task
    scores its queries once per field, evaluates every candidate with one
    einsum and emits one partial hit count per candidate (Spark sums them).
    Over the limit, KB blocks and query buckets are co-grouped; each group
    emits its best (score, code) per query and candidate, and a group-by per
    (query, candidate) keeps the overall best."""
    spark = queries.sparkSession
    ship_package(spark)
    slab, n_kb, dim = prepared if prepared is not None else _kb_fields(kb, limit_bytes, force_blocked)
    cand = np.array([normalized_weights(c) for c in candidates], dtype=np.float64)  # (C, 6)
    wdf = _candidate_frame(spark, cand)
    if slab is None:
        tot = _weight_hits_blocked(queries, kb, cand, truth, query_id, n_kb, dim, max_cells,
                                   kb_block_rows, query_block_rows)
    else:
        tot = _weight_hits_broadcast(queries, slab, cand, truth, dim, max_cells)
    return (tot.join(F.broadcast(wdf), "candidate")   # C rows: the candidate list itself
            .select("candidate", *[f"w_{f}" for f in FIELDS], "hits", "rows",
                    F.try_divide(F.col("hits").cast("double"), F.col("rows")).alias("accuracy")))


def _weight_hits_broadcast(queries, slab, cand, truth, dim, max_cells):
    bc = queries.sparkSession.sparkContext.broadcast((slab, cand))
    schema = T.StructType([T.StructField("candidate", T.IntegerType()), T.StructField("hits", T.LongType()),
                           T.StructField("rows", T.LongType())])

    def run(batches):
        s, cw = bc.value
        hits = np.zeros(len(cw), dtype=np.int64)
        rows = 0
        step = max(1, max_cells // max(s.n * max(len(FIELDS), len(cw)), 1))
        for batch in batches:
            t, known = line.true_places(batch.column(truth), s)
            for a in range(0, len(known), step):
                part = known.slice(a, step)
                q = _unit_rows(vec_rows(batch.column("vec").take(part), dim))
                comb = np.tensordot(cw, _per_field(q, s), axes=1)    # (C, rows, n_kb)
                pred = np.round(comb, RANK_DECIMALS).argmax(axis=2)  # first (lowest code) on ties
                hits += (pred == t[a:a + step][None, :]).sum(axis=1)
                rows += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cw)), pa.int32()), pa.array(hits),
                                          pa.array(np.full(len(cw), rows, dtype=np.int64))], schema.names)

    part = queries.select("vec", F.col(truth).cast("string").alias(truth)).mapInArrow(run, schema)
    return part.groupBy("candidate").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))


def _weight_hits_blocked(queries, kb, cand, truth, query_id, n_kb, dim, max_cells, kb_block_rows, query_block_rows):
    k = reliable_checkpoint(one_per_code(kb))
    known = k.select(F.col("code").alias(truth))
    # rows are told apart by a number of their own: ids may repeat or be null
    query_id = "_query_row"
    q = dense_vectors(queries.select("vec", truth)).join(known, truth, "left_semi").withColumn(query_id, F.monotonically_increasing_id())
    q = reliable_checkpoint(q)
    # six per-field matrices per KB row; a co-group side holds about 64 MB
    n_b = max(1, math.ceil(n_kb / block_rows(kb_block_rows, 64 << 20, dim * len(FIELDS))))
    n_q = max(1, math.ceil(q.count() / block_rows(query_block_rows, 64 << 20, dim, floor=1000)))
    qb = (q.withColumn("q_bucket", F.pmod(F.xxhash64(query_id), F.lit(n_q)).cast("int"))
          .withColumn("kb_block", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1)))))
    kbb = (k.withColumn("kb_block", F.pmod(F.xxhash64("code"), F.lit(n_b)).cast("int"))
           .withColumn("q_bucket", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))))
    schema = T.StructType([T.StructField(query_id, T.LongType()), T.StructField("candidate", T.IntegerType()),
                           T.StructField("score", T.DoubleType()), T.StructField("code", T.StringType()),
                           T.StructField(truth, T.StringType())])

    def block(qpdf: pd.DataFrame, kpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or kpdf.empty:
            return typed_empty(schema)
        s = FieldSlab(kpdf, dim)
        outs = []
        step = max(1, max_cells // max(s.n * max(len(FIELDS), len(cand)), 1))
        for a in range(0, len(qpdf), step):
            part = qpdf.iloc[a:a + step]
            qv = _unit_rows(_stack(part["vec"].tolist(), dim))
            comb = np.tensordot(cand, _per_field(qv, s), axes=1)
            best = np.round(comb, RANK_DECIMALS).argmax(axis=2)          # (C, rows)
            score = np.take_along_axis(comb, best[:, :, None], 2)[:, :, 0]
            c_n, r_n = best.shape
            outs.append(pd.DataFrame({
                query_id: np.tile(part[query_id].to_numpy(), c_n),
                "candidate": np.repeat(np.arange(c_n, dtype=np.int32), r_n),
                "score": score.ravel(), "code": s.codes[best.ravel()],
                truth: np.tile(part[truth].to_numpy(), c_n)}))
        return pd.concat(outs, ignore_index=True)

    best = (qb.groupBy("kb_block", "q_bucket").cogroup(kbb.groupBy("kb_block", "q_bucket"))
            .applyInPandas(block, schema)
            .groupBy(query_id, "candidate")
            .agg(F.min(F.struct((-F.round("score", RANK_DECIMALS)).alias("neg"), "code", truth)).alias("b")))
    hit = (F.col("b.code") == F.col(f"b.{truth}")).cast("long")
    return best.groupBy("candidate").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("rows"))


def candidate_weights(n: int, seed: int = 42, fields: int = len(FIELDS)) -> list[tuple[float, ...]]:
    """``n`` weight vectors in [0, 1)^6 from the arithmetic hash
    ``(x * 1103515245 + 12345) mod 2147483647``, which SQL can repeat."""
    step = lambda x: (x * 1103515245 + 12345) % 2147483647
    return [tuple(step(step((seed + c) * fields + f)) / 2147483647 for f in range(fields)) for c in range(n)]


def weight_search(queries: DataFrame, kb: DataFrame, truth: str = "truth_code", candidates: int = 300, seed: int = 42,
                  baseline=SEARCH_BASELINE, rounds: int = 3, limit_bytes: int = 256 << 20, max_cells: int = 1 << 22,
                  force_blocked: bool = False, kb_block_rows: int = 20_000, query_block_rows: int = 200_000) -> DataFrame:
    """Field weights by top-1 accuracy: the best of ``candidates`` seeded vectors
    and the baseline (ties: the earlier one, the baseline first), all scored in
    one job, then up to ``rounds`` exact line searches from there, one job each:
    the best share of any one field is taken (``linesearch``) while it adds
    hits. The end is scored like the start and kept unless it is worse.

    Queries whose true code is not in ``kb`` count nowhere; a null vector is
    zero. Returns ``(field, weight)`` rows (normalised) with the accuracy found
    and the baseline's (0 without queries). The reference walks the same space
    with a stochastic solver; the objective and the output are the same."""
    spark = queries.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = queries.select(F.monotonically_increasing_id().alias("query_id"), "vec", truth)
    queries = written(queries.repartition(tasks), "search-rows")  # a sample may come in few partitions; every job reads it
    kb = written(one_per_code(kb), "search-kb")
    prepared = _kb_fields(kb, limit_bytes, force_blocked)
    slab, n_kb, dim = prepared
    sizes = {"max_cells": max_cells, "kb_block_rows": kb_block_rows, "query_block_rows": query_block_rows}

    def hits(tried) -> dict[int, tuple]:  # one row per candidate
        rows = weight_accuracy(queries, kb, tried, truth, force_blocked=slab is None, prepared=prepared, **sizes).collect()
        return {r["candidate"]: (r["hits"], r["accuracy"] or 0.0) for r in rows}

    tried = [tuple(baseline), *candidate_weights(candidates, seed)]
    scored = hits(tried)
    start = max(range(len(tried)), key=lambda c: (scored.get(c, (0, 0.0))[0], -c))
    found, (best, accuracy) = normalized_weights(tried[start]), scored.get(start, (0, 0.0))
    handle = spark.sparkContext.broadcast(slab) if slab is not None else None
    path = [found]
    for _ in range(rounds):
        if handle is not None:
            events = line.events_broadcast(queries, handle, path[-1], truth, dim, max_cells)
        else:
            events = line.events_blocked(queries, kb, path[-1], truth, n_kb, dim, FieldSlab, **sizes)
        step = line.best_piece(events)
        if step is None or step[2] <= best:
            break
        best = step[2]
        path.append(line.moved(path[-1], step[0], step[1]))
    if handle is not None:
        handle.destroy()
    if len(path) > 1:
        end = hits([path[-1]]).get(0, (0, 0.0))
        if end[0] >= scored[start][0]:
            found, accuracy = path[-1], end[1]
    return spark.createDataFrame(
        [(name, float(w), accuracy, scored.get(0, (0, 0.0))[1]) for name, w in zip(WEIGHT_NAMES, found, strict=True)],
        "field string, weight double, accuracy double, baseline_accuracy double")
