"""Quality classifier: held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import no_docs, odd_docs  # noqa: F401  fixtures
from taxomatch.llm import quality
from taxomatch.llm.common import crc_mod

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = quality.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    out = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    hit = {q: np.mean([got[r.doc_id].predicted == q for r in out if r.quality == q]) for q in (0, 1)}
    assert hit[0] > 0.95 and hit[1] > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_not_read(tables):
    docs, labels = tables
    docs, labels = docs.where("doc_id < 800"), labels.where("doc_id < 800")
    usable = crc_mod("doc_id", 3) != 1
    a = quality.fit(docs, labels, usable)
    b = quality.fit(docs, labels.withColumn("quality", F.when(usable, F.col("quality")).otherwise(1 - F.col("quality"))), usable)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_scorer_agrees_with_the_document_features(odd_docs):
    rng = np.random.default_rng(0)
    model = rng.normal(size=quality.REPEAT + 1).astype(np.float32), 0.3
    texts = [(r.text or "").encode() for r in odd_docs.collect()] + [b"a a a b", b"b b", b"x"]
    scorer = quality.Scorer(*model)
    got = np.concatenate([scorer.score(texts[k:k + 9]) for k in range(0, len(texts), 9)])
    for t, s in zip(texts, got):
        bucket, share = quality.document(t)
        z = float((model[0][bucket].astype(float) * share).sum()) + 0.3
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-5
    assert np.allclose(quality.Scorer(*model).score([b"", b"a a", b""]), [scorer.score([x])[0] for x in (b"", b"a a", b"")])


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99_999, 0)], "doc_id long, quality int")
    one = quality.fit(odd_docs, labels, F.lit(True))
    assert {r.predicted for r in quality.score(odd_docs, one).collect()} == {1}
    none = quality.fit(odd_docs, labels.limit(0), F.lit(True))
    rows = quality.score(odd_docs, none).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == odd_docs.count()
    assert quality.score(no_docs, one).count() == 0
    kept = quality.keep(odd_docs, one)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
