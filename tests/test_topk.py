"""Sparse top-k against all pairs in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from taxomatch.operators import lexical as lx
from taxomatch.operators.topk import sparse_topk


def every_pair(queries, postings, codes, k, fill, repeats=True):
    out = {}
    for q, toks in queries.items():
        count = {t: toks.count(t) if repeats else 1 for t in toks}
        score = {c: sum(n * w for t, n in count.items() if (w := postings.get((c, t))) is not None) for c in codes}
        top = max(score.values(), default=0)
        if top > 0:
            score = {c: s / top for c, s in score.items()}
        ranked = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
        ranked = ranked if fill else [x for x in ranked if x[1] > 0]
        if ranked:
            out[q] = [(c, round(s, 9)) for c, s in ranked]
    return out


def case(seed, negative):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(30)]
    codes = [f"c{i:02d}" for i in range(rng.choice([2, 12, 25]))]
    postings = {(c, t): rng.choice([-1.0, -0.5, 0.0] if negative and rng.random() < 0.4 else [0.25, 0.5, 1.0, 2.0]) for c in codes[1:] for t in rng.sample(vocab, rng.randint(0, 12))}
    queries = {q: [rng.choice([*vocab, "unknown"]) for _ in range(rng.choice([0, 1, 3, 20, 60]))] for q in range(40)}
    return queries, postings, codes


@pytest.mark.parametrize("seed,negative,seed_tokens", [(1, False, 6), (2, False, 1), (3, True, 2), (4, True, 6)])
def test_equals_all_pairs(spark, seed, negative, seed_tokens):
    queries, postings, codes = case(seed, negative)
    if not any(w < 0 for w in postings.values()) and negative:
        postings[codes[-1], "t0"] = -1.0
    rows = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, token string")
    post = spark.createDataFrame([(c, t, w) for (c, t), w in postings.items()], "code string, token string, weight double")
    kb = spark.createDataFrame([(c,) for c in codes], "code string")
    keys = spark.createDataFrame([(q,) for q in queries], "query_id long")
    for fill in (None, keys):
        got = {}
        for r in sparse_topk(rows, post, kb, 3, fill=fill, seed_tokens=seed_tokens).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.code, round(r.relative, 9)))
            assert r["rank"] == len(got[r.query_id])
        assert got == every_pair(queries, postings, codes, 3, fill is not None)


def test_overlap_counts_a_word_once_and_lists_hits_alone(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    docs = {q: rng.sample(words, rng.randint(0, 20)) for q in range(30)}
    kb = {f"k{i:02d}": rng.sample(words, rng.randint(0, 9)) for i in range(15)}
    q = spark.createDataFrame([*docs.items(), (3, docs[3]), (99, None)], "query_id long, title_words array<string>")
    k = spark.createDataFrame(list(kb.items()), "code string, title_words array<string>")
    got = {}
    for r in lx.overlap_topk(q, k, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.code, r.overlap))
    want = {}
    for d, ws in docs.items():
        hits = sorted(((c, len(set(ws) & set(x))) for c, x in kb.items() if set(ws) & set(x)), key=lambda x: (-x[1], x[0]))[:4]
        if hits:
            want[d] = hits
    assert got == want


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "query_id long, tokens array<string>")
    corpus = spark.createDataFrame([("x", "b c"), ("y", None)], "code string, text string")
    got = sorted((r.query_id, r["rank"], r.code, r.score) for r in lx.bm25_topk(docs, corpus, 3).collect())
    assert got == [(q, i + 1, c, 0.0) for q in (1, 2, 3) for i, c in enumerate("xy")]
    assert lx.bm25_topk(docs.limit(0), corpus, 3).count() == 0
    assert lx.bm25_topk(docs, corpus.limit(0), 3).count() == 0


def test_plan_holds_no_python_and_no_pair_of_all(spark):
    from taxomatch.plans import catalogue

    for f in (catalogue.bm25_scores, catalogue.title_overlap):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_last_tokens_are_not_joined(spark):
    """A common word that cannot lift an item among the best costs no rows."""
    kb = [(f"k{i:03d}", "common", 0.01) for i in range(200)] + [(f"k{i:03d}", f"rare{j}", 5.0) for i in range(3) for j in range(4)]
    post = spark.createDataFrame(kb, "code string, token string, weight double")
    rows = spark.createDataFrame([(1, t) for t in ("common", *[f"rare{j}" for j in range(4)])], "query_id long, token string")
    r = sparse_topk(rows, post, post.select("code"), 3, seed_tokens=2)
    assert [(x.code, x["rank"]) for x in r.orderBy("rank").collect()] == [("k000", 1), ("k001", 2), ("k002", 3)]
    assert r.select(F.min("score")).first()[0] > 20


@pytest.mark.parametrize("full_rows", [0, 40, 1 << 40])
def test_sums_and_bounds_give_the_same(spark, full_rows):
    """Queries that meet few postings are summed, the others bounded."""
    queries, postings, codes = case(5, True)
    rows = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, token string")
    post = spark.createDataFrame([(c, t, w) for (c, t), w in postings.items()], "code string, token string, weight double")
    kb = spark.createDataFrame([(c,) for c in codes], "code string")
    keys = spark.createDataFrame([(q,) for q in queries], "query_id long")
    got = {}
    for r in sparse_topk(rows, post, kb, 3, fill=keys, seed_tokens=2, full_rows=full_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.code, round(r.relative, 9)))
    assert got == every_pair(queries, postings, codes, 3, True)


def test_tasks_grow_with_the_postings_met(spark, monkeypatch):
    """The pairs are dealt by query over tasks in number with the work, not merged by the size of their bytes."""
    from taxomatch.operators import topk

    monkeypatch.setattr(topk, "TASK_ROWS", 100)
    post = spark.createDataFrame([(f"k{i}", "w", 1.0) for i in range(20)], "code string, token string, weight double")
    rows = spark.range(200).select(F.col("id").alias("query_id"), F.lit("w").alias("token"))
    p = topk.Postings(post, post.select("code"), repeats=False)
    q = p.queries(rows, "query_id")
    assert p.tasks == 41 and p.work == 20
    summed = p.summed(q, "query_id")
    assert summed.rdd.getNumPartitions() == 41 and summed.count() == 4000
    assert "ArrayIntersect" not in summed._jdf.queryExecution().toString() and "array_intersect" not in summed._jdf.queryExecution().toString()
