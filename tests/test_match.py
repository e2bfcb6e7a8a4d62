"""Matcher properties: both physical paths agree, and agree with a brute-force
numpy computation of the unfused reference formula."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from taxomatch.functions.vectors import FIELDS, TUNED_WEIGHTS, WEIGHT_NAMES
from taxomatch.operators.lexical import bm25_index
from taxomatch.operators.match import MatchConfig, match, match_one
from taxomatch.plans import standins as si


def _brute(q_rows, kb_rows, weights, boost):
    kb_rows = sorted(kb_rows, key=lambda r: r["code"])
    out = {}
    w = [weights[n] for n in WEIGHT_NAMES]
    for q in q_rows:
        qv = np.array(q["vec"])
        scores = []
        for k in kb_rows:
            s = 0.0
            for f, wf in zip(FIELDS, w):
                kv = np.array(k[f"vec_{f}"])
                nq, nk = np.linalg.norm(qv), np.linalg.norm(kv)
                s += wf * (float(qv @ kv) / (nq * nk) if nq > 0 and nk > 0 else 0.0)
            ov = len(set(q["title_words"]) & set(k["title_words"]))
            scores.append((-(s + boost * ov), k["code"], s))
        scores.sort()
        out[q["query_id"]] = [(c, -f, r) for f, c, r in scores[:3]]
    return out


def _collect(df):
    return {r["query_id"]: list(zip(r["codes"], r["scores"], r["raw_scores"])) for r in df.collect()}


def _same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [x[0] for x in a[k]] == [x[0] for x in b[k]], k
        for x, y in zip(a[k], b[k]):
            assert math.isclose(x[1], y[1], abs_tol=1e-9) and math.isclose(x[2], y[2], abs_tol=1e-9)


def test_broadcast_blocked_and_brute_force_agree(spark):
    q = si.vector_queries(spark, SF001).drop("label")
    kb = si.vector_kb(spark, SF001)
    cfg = MatchConfig(weights=TUNED_WEIGHTS, title_boost=0.03)
    fast = _collect(match(q, kb, cfg))
    blocked = _collect(match(q, kb, MatchConfig(weights=TUNED_WEIGHTS, title_boost=0.03, force_blocked=True,
                                                kb_block_rows=3, query_block_rows=97)))
    brute = _brute(q.collect(), kb.collect(), TUNED_WEIGHTS, 0.03)
    _same(fast, blocked)
    _same(fast, brute)


def test_result_independent_of_partitioning(spark):
    q = si.vector_queries(spark, SF001).drop("label")
    kb = si.vector_kb(spark, SF001)
    a = _collect(match(q.repartition(1), kb))
    b = _collect(match(q.repartition(13), kb))
    _same(a, b)


def test_weight_scaling_keeps_ranking(spark):
    q = si.vector_queries(spark, SF001).drop("label")
    kb = si.vector_kb(spark, SF001)
    a = match(q, kb, MatchConfig(weights=TUNED_WEIGHTS)).select("query_id", "codes")
    b = match(q, kb, MatchConfig(weights={k: 3 * v for k, v in TUNED_WEIGHTS.items()})).select("query_id", "codes")
    assert {r[0]: r[1] for r in a.collect()} == {r[0]: r[1] for r in b.collect()}


def _bm25_reference(corpus, query, k1=1.5, b=0.75, eps=0.25):
    """Plain-Python Okapi BM25 over token lists (brute force)."""
    n = len(corpus)
    avgdl = sum(len(d) for d in corpus) / n
    df = {}
    for d in corpus:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (eps * mean if v < 0 else v) for t, v in idf.items()}
    out = []
    for d in corpus:
        s = 0.0
        for t in query:
            f = d.count(t)
            s += idf.get(t, 0.0) * (f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avgdl)))
        out.append(s)
    return out


def test_bm25_matches_brute_force(spark):
    docs = [("a", "the cat sat on the mat"), ("b", "the dog sat"), ("c", "cats and dogs"), ("d", "")]
    kb = spark.createDataFrame([(c, c, t) for c, t in docs], "code string, title string, text string")
    kb = kb.join(bm25_index(kb, "code", "text"), "code", "left")
    qs = [(1, "the cat the mat"), (2, "dogs"), (3, "zebra")]
    q = spark.createDataFrame(qs, "query_id long, text string").select(
        "query_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("tokens"))
    cfg = MatchConfig(weights={n: 0.0 for n in WEIGHT_NAMES}, bm25_weight=1.0, k=4)
    res = match(q, kb, cfg)
    got = {r["query_id"]: dict(zip(r["codes"], r["scores"])) for r in res.collect()}
    blocked = match(q, kb, MatchConfig(weights=cfg.weights, bm25_weight=1.0, k=4, force_blocked=True, kb_block_rows=2))
    assert {r["query_id"]: dict(zip(r["codes"], r["scores"])) for r in blocked.collect()} == got
    for qid, text in qs:
        ref = _bm25_reference([t.split() for _, t in docs], text.split())
        mx = max(ref)
        ref = [s / mx if mx > 0 else s for s in ref]
        for (code, _), s in zip(docs, ref):
            assert math.isclose(got[qid][code], s, abs_tol=1e-12), (qid, code)


def test_single_lookup_refuses_blank(spark):
    kb = si.vector_kb(spark, SF001)
    try:
        match_one(spark, kb, "  ", "", encode=lambda df: df)
    except ValueError:
        return
    raise AssertionError("blank title accepted")


def test_weight_accuracy_blocked_equals_broadcast(spark):
    from taxomatch.operators.evaluate import weight_accuracy
    from taxomatch.plans.catalogue import WEIGHT_CANDIDATES, _truth_queries

    q = _truth_queries(spark, SF001)
    kb = si.vector_kb(spark, SF001)
    a = {r["candidate"]: (r["hits"], r["rows"]) for r in weight_accuracy(q, kb, WEIGHT_CANDIDATES).collect()}
    b = {r["candidate"]: (r["hits"], r["rows"]) for r in weight_accuracy(
        q, kb, WEIGHT_CANDIDATES, force_blocked=True, kb_block_rows=3, query_block_rows=120).collect()}
    assert a == b and len(a) == len(WEIGHT_CANDIDATES)


def test_large_kb_sparse_boost_and_ties_vs_brute_force(spark):
    """KB above the small-sort cut (sparse postings, argpartition top-k with
    ties) against plain numpy."""
    rng = np.random.default_rng(7)
    n_kb, n_q, dim = 1500, 120, 8
    words = [f"w{i}" for i in range(60)]
    kb_vecs = np.round(rng.normal(size=(n_kb, dim)), 1)   # coarse values -> ties
    kb_vecs[:50] = kb_vecs[50:100]                         # exact duplicate vectors -> tied scores
    kb_words = [sorted(set(rng.choice(words, 3))) for _ in range(n_kb)]
    kb_rows = [(f"c{j:05d}", f"t{j}", kb_vecs[j].tolist(), kb_words[j]) for j in range(n_kb)]
    kb = spark.createDataFrame(kb_rows, "code string, title string, vec_ofc_title array<double>, title_words array<string>")
    q_vecs = np.round(rng.normal(size=(n_q, dim)), 1)
    q_words = [sorted(set(rng.choice(words, 2))) for _ in range(n_q)]
    q = spark.createDataFrame([(i, q_vecs[i].tolist(), q_words[i]) for i in range(n_q)],
                              "query_id long, vec array<double>, title_words array<string>")
    w = {n: 0.0 for n in WEIGHT_NAMES}
    w["Ofc_Title"] = 1.0
    got = _collect(match(q, kb, MatchConfig(weights=w, title_boost=0.03, k=5)))
    kn = kb_vecs / np.linalg.norm(kb_vecs, axis=1, keepdims=True)
    for i in range(n_q):
        raw = kn @ (q_vecs[i] / np.linalg.norm(q_vecs[i]))
        fin = raw + 0.03 * np.array([len(set(q_words[i]) & set(kw)) for kw in kb_words])
        order = sorted(range(n_kb), key=lambda j: (-fin[j], kb_rows[j][0]))[:5]
        assert [c for c, _, _ in got[i]] == [kb_rows[j][0] for j in order], i
        assert np.allclose([s for _, s, _ in got[i]], fin[order], atol=1e-9)


def test_single_lookup_returns_top3(spark):
    from taxomatch.operators.encode import BatchEncoder

    kb = si.vector_kb(spark, SF001)
    first = kb.orderBy("code").first()
    vec = first["c"]

    def load():
        return lambda texts: [vec for _ in texts]   # every text encodes to label 0's centroid

    r = match_one(spark, kb, "Nurse Supervisors", "", encode=lambda df: BatchEncoder(load, len(vec))(df, "text", "vec"),
                  cfg=MatchConfig(weights=TUNED_WEIGHTS, title_boost=0.03)).first()
    assert len(r["codes"]) == 3 and r["codes"][0] == first["code"]


def test_sparse_vectors_match_as_dense_ones(spark):
    """Both physical paths, the weight search too, take sparse vectors: null and
    empty ones are zero, a width other than the knowledge base's is an error."""
    from taxomatch.operators import evaluate as ev
    from taxomatch.operators.encode import SPARSE

    rng = np.random.default_rng(5)
    dim = 6
    vectors = [None, [0.0] * dim] + [[float(x) if x > 3 else 0.0 for x in rng.integers(0, 9, dim)] for _ in range(40)]
    codes = [f"c{k}" for k in range(7)]
    rows = [(k if k % 5 else None, v, None if v is None else (dim, [p for p, x in enumerate(v) if x], [x for x in v if x]), (codes + [None, "no"])[k % 9])
            for k, v in enumerate(vectors)]
    q = spark.createDataFrame(rows, f"query_id long, vec array<double>, few {SPARSE}, truth_code string").repartition(3)
    fields = ", ".join(f"vec_{f} array<double>" for f in FIELDS)
    kb = spark.createDataFrame([(c, f"t {c}", *[[float(x) for x in rng.integers(0, 4, dim)] for _ in FIELDS]) for c in codes], f"code string, title string, {fields}")
    few = q.drop("vec").withColumnRenamed("few", "vec")
    of = lambda df: sorted(df.select("query_id", "truth_code", "codes", "titles", "scores").collect(), key=str)
    for blocked in (False, True):
        cfg = MatchConfig(force_blocked=blocked)
        assert of(match(few, kb, cfg)) == of(match(q.drop("few"), kb, cfg))
        found = [ev.weight_search(x, kb, candidates=3, force_blocked=blocked).collect() for x in (few, q)]
        assert found[0] == found[1]
    narrow = few.where("vec is not null").withColumn("vec", F.col("vec").withField("dim", F.lit(dim + 1)))
    with pytest.raises(Exception, match="knowledge base has 6"):
        match(narrow, kb).collect()


def test_first_places_by_maxima_are_those_of_a_stable_sort():
    import pandas as pd

    from taxomatch.operators.match import KbSlab

    rng = np.random.default_rng(3)
    slab = KbSlab(pd.DataFrame({"code": [f"{k:03d}" for k in range(50)], "title": ""}), MatchConfig(), 0)
    final = rng.integers(0, 6, (200, 50)) / 3.0
    assert (slab.topk(final, 3) == np.argsort(-final, axis=1, kind="stable")[:, :3]).all()
    final[7, 9] = np.nan
    assert (slab.topk(final, 3) == np.argsort(-np.round(final, 12), axis=1, kind="stable")[:, :3]).all()


@pytest.mark.parametrize("query", ["text_eval_summary", "weight_search_text"])
def test_text_matchers_join_the_orders_once(spark, monkeypatch, query):
    from taxomatch.plans import catalogue, standins

    read = []
    table = standins.table
    monkeypatch.setattr(standins, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    catalogue.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert read.count("orders") == 1
