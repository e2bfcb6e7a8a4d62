"""The similarity join against every product in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxomatch.operators.simjoin import SimilarityJoin


def data(seed, n_kb, n_q, dim=6, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    kb = centres[rng.integers(0, 8, n_kb)] + spread * rng.normal(size=(n_kb, dim))
    q = centres[rng.integers(0, 8, n_q)] + spread * rng.normal(size=(n_q, dim))
    kb[::17] = kb[0]  # equal vectors: ties
    kb[::23] = 0
    q[::9] = 0
    return kb, q


def want_of(codes, kb, q, k):
    n = np.linalg.norm(q, axis=1, keepdims=True)
    p = np.round((q / np.where(n > 0, n, 1)) @ kb.T, 12)
    return [[codes[j] for j in sorted(range(len(kb)), key=lambda j: (-row[j], codes[j], j))[:k]] for row in p]


@pytest.mark.parametrize("seed,n_kb,k,block_rows", [(1, 900, 3, 40), (2, 900, 1, 7), (3, 300, 5, 1000), (4, 2, 3, 1), (5, 1, 3, 4)])
def test_equals_all_products(spark, seed, n_kb, k, block_rows):
    kb, q = data(seed, n_kb, 60)
    codes = [f"c{j // 2:04d}" for j in range(n_kb)]  # repeated codes
    kdf = spark.createDataFrame([(c, v.tolist()) for c, v in zip(codes, kb, strict=True)], "code string, vec array<double>").repartition(3)
    rows = [(i // 3 if i % 5 else None, i, v.tolist()) for i, v in enumerate(q)]  # repeated and null ids
    rows += [(None, 60, None), (7, 61, [])]
    qdf = spark.createDataFrame(rows, "query_id long, own int, vec array<double>").repartition(2)
    join = SimilarityJoin(kdf, block_rows=block_rows, query_rows=16)
    got = {}
    for r in join.topk(qdf, k).orderBy("own", "rank").collect():
        got.setdefault(r.own, []).append(r.code)
    want = want_of(codes, kb, np.vstack([q, np.zeros((2, q.shape[1]))]), k)
    assert [got[i] for i in range(62)] == want
    if n_kb >= 900:
        assert join.visits.count() < 0.6 * 60 * len(join.ids)  # most blocks are never met


def test_empty_sides_and_wrong_width(spark):
    kdf = spark.createDataFrame([("a", [1.0, 0.0])], "code string, vec array<double>")
    qdf = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    assert SimilarityJoin(kdf.limit(0)).topk(qdf).count() == 0
    assert SimilarityJoin(kdf).topk(qdf.limit(0)).count() == 0
    with pytest.raises(Exception, match="components"):
        SimilarityJoin(kdf).topk(qdf.withColumn("vec", F.array(F.lit(1.0)))).collect()
