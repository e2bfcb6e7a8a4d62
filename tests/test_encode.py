"""Encoders: weighted task vectors, chunk means, blank and bad inputs."""

import numpy as np
from pyspark.sql import functions as F

from taxomatch.operators.encode import BatchEncoder, HashingEncoder, encode_chunked, encode_weighted_tasks


def _toy_encoder(dim=4):
    def load():
        def model(texts):
            # deterministic toy model: letter counts of a, b, c, d
            return np.array([[t.count(ch) for ch in "abcd"] for t in texts], dtype=float)
        return model
    return BatchEncoder(load, dim)


def test_weighted_tasks_json_bad_json_and_empty(spark):
    rows = [("k1", '[{"task": "aa", "weight": 1.0}, {"task": "b", "weight": 3.0}, {"task": "", "weight": 9.0}]'),
            ("k2", "not json"), ("k3", "[]"), ("k4", '[{"task": "c"}]')]
    df = spark.createDataFrame(rows, "code string, tasks string")
    got = {r["code"]: r["vec_task"] for r in encode_weighted_tasks(df, "code", _toy_encoder()).collect()}
    assert np.allclose(got["k1"], [(2 * 1.0) / 4.0, (1 * 3.0) / 4.0, 0, 0])
    assert got["k2"] == [0.0] * 4 and got["k3"] == [0.0] * 4
    assert np.allclose(got["k4"], [0, 0, 1, 0])   # missing weight counts as 0.5


def test_chunk_mean_and_blank(spark):
    text = " ".join(["ab"] * 10 + ["cd"] * 10)
    df = spark.createDataFrame([("x", text), ("y", "   "), ("z", None)], "key string, text string")
    got = {r["key"]: r["vec"] for r in encode_chunked(df, "key", "text", _toy_encoder(), width=14).collect()}
    chunks = ["ab ab ab ab ab", "ab ab ab ab ab", "cd cd cd cd cd", "cd cd cd cd cd"]
    exp = np.mean([[c.count(ch) for ch in "abcd"] for c in chunks], axis=0)
    assert np.allclose(got["x"], exp)
    assert got["y"] == [0.0] * 4 and got["z"] == [0.0] * 4


def test_hashing_encoder_unit_norm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = HashingEncoder(dim=32).fit(docs, "text")
    v = enc(docs.select("doc_id", "text"), "text", "vec")
    norms = [r[0] for r in v.select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).collect()]
    assert all(abs(n - 1.0) < 1e-9 or n == 0.0 for n in norms)


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    """Many tasks and two jobs: one load in each worker process that ran any."""
    import os
    import uuid

    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.array([[len(t), os.getpid()] for t in texts], dtype=float)

    enc = BatchEncoder(load, 2, max_rows=3)
    df = spark.range(400).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")).repartition(16)
    seen = set()
    for _ in range(2):
        rows = enc(df).collect()
        assert all(r["vec"][0] == r["id"] % 50 for r in rows) and len(rows) == 400
        seen |= {int(r["vec"][1]) for r in rows}
    loads = [int(f.split("-")[0]) for f in os.listdir(folder)]
    assert len(loads) == len(set(loads)) and seen <= set(loads) and len(loads) < 32


def test_batches_hold_texts_of_like_length():
    from taxomatch.operators.encode import length_batches

    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(0, 40, 500), rng.integers(1000, 5000, 20), [20_000, 0]])
    parts = list(length_batches(lengths, 64, 8000))
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(lengths)))
    assert all(len(p) <= 64 and (len(p) == 1 or len(p) * lengths[p].max() <= 8000) for p in parts)
    padded = sum(len(p) * int(lengths[p].max()) for p in parts)
    plain = sum(len(lengths[a:a + 64]) * int(lengths[a:a + 64].max()) for a in range(0, len(lengths), 64))
    assert padded < 1.3 * lengths.sum() < plain
    assert list(length_batches(np.zeros(0, dtype=np.int64), 64, 8000)) == []


def test_batch_encoder_on_odd_texts(spark):
    from taxomatch.operators.encode import pooled_table_model

    df = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "a A"), (5, "a"), (6, "long " * 50_000)], "id long, text string")
    got = {r["id"]: r["vec"] for r in BatchEncoder(pooled_table_model(4), 4)(df).collect()}
    assert got[1] == got[2] == got[3] == [0.0] * 4 and got[4] == got[5] != [0.0] * 4 and len(got[6]) == 4
    assert BatchEncoder(pooled_table_model(4), 4)(df.where("false")).count() == 0


def test_hashing_encoder_by_hand(spark):
    """Counts, document frequencies and lengths as plain Python has them, for
    odd whitespace, cases, blank, null and long texts; sparse and dense alike.
    Tokens are hashed once per distinct token of a batch, not by expressions."""
    import math
    from hashlib import md5

    dim = 16
    texts = ["Ab aB  c\x1cd e\x85", None, "", " \t\n", "İstanbul ÉtÉ " * 30, "x" * 5000 + " y", "a​b a b -- ab"] + [f"w{k} w{k % 7}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    low = {r["id"]: r["t"] for r in df.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    counts = {}
    for k, t in low.items():
        counts[k] = [0] * dim
        for w in t.split():
            counts[k][int(md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    held = [sum(c[b] > 0 for c in counts.values()) for b in range(dim)]
    enc = HashingEncoder(dim).fit(df, "text")
    both = enc(enc(df, "text", "vec"), "text", "few", sparse=True)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "md5(" not in plan and "lambda" not in plan
    rows = both.collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = [c * math.log((len(texts) + 1) / (h + 1)) for c, h in zip(counts[r["id"]], held)]
        n = math.sqrt(sum(v * v for v in x))
        assert np.allclose(r["vec"], [v / n if n else 0.0 for v in x], rtol=0, atol=1e-12)
        full = [0.0] * r["few"]["dim"]
        for p, v in zip(r["few"]["pos"], r["few"]["value"]):
            full[p] = v
        assert full == r["vec"]


def test_texts_are_counted_in_bounded_pieces():
    import pyarrow as pa

    from taxomatch.operators import encode

    texts = pa.array(["ab" * (k % 5) for k in range(20_000)] + ["z" * (40 << 20), None, "q"])
    parts = list(encode.pieces(texts))
    assert pa.concat_arrays(parts).equals(texts)
    assert all(len(p) <= encode.PIECE_ROWS for p in parts) and len(parts) <= 5


def test_chunks_are_made_of_text_spaced_once(spark):
    """The generator holds no whitespace pattern of its own: it made the spaced
    text anew for each mention of it."""
    df = spark.createDataFrame([("x", " a\t\tb \n c "), ("y", "  well-known  ")], "key string, text string")
    out = encode_chunked(df, "key", "text", _toy_encoder(), width=14)
    generate = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert len(generate) == 1 and "\\s{2,}" not in generate[0] and "\\s+" not in generate[0]
    from taxomatch.functions import text as tx

    got = [r[0] for r in df.select(tx.single_spaced("text")).collect()]
    assert got[0] == "a b c"
