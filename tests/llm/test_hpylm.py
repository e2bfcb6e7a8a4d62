"""Pitman-Yor model: counts, normalisation, seating, independence of blocks."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import no_docs  # noqa: F401  fixtures
from taxomatch.llm import hpylm, wordblocks
from taxomatch.llm.common import crc_mod


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    after = {w: rng.choices(vocab, k=4) for w in vocab}

    def walk(k):
        out = [rng.choice(vocab)]
        while len(out) < k:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    texts = [walk(rng.randint(1, 60)) for _ in range(n)]
    phrase = "Always the same words in this order"
    texts = [t if k % 3 else f"{phrase} {t}" for k, t in enumerate(texts)]
    return [*texts, None, "", " \n", texts[0], "never-seen words", "x" * 30_000, " ".join(vocab) * 50]


@pytest.fixture
def docs(spark):
    rows = [(k if k != 5 else None, t, 1.0, "x") for k, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string").repartition(3)


def test_counts_and_base(docs):
    got = {r.doc_id: r for r in hpylm.score(docs, crc_mod("doc_id", 10) == 0).collect()}
    words = {r.doc_id: (r.text or "").lower().split() + [None] for r in docs.collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    assert got.keys() == words.keys()
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better perplexity on texts not learned from


def test_scores_do_not_depend_on_blocks(docs, monkeypatch):
    run = lambda: sorted((str(r.doc_id), r.score) for r in hpylm.score(docs, crc_mod("doc_id", 10) == 0).collect())
    whole = run()
    monkeypatch.setattr(wordblocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(wordblocks, "BUCKET_WORDS", 700)
    assert [x[0] for x in run()] == [x[0] for x in whole]
    assert np.allclose([x[1] for x in run()], [x[1] for x in whole], rtol=1e-9)


def test_probabilities_sum_to_one(spark):
    """All words that may follow a context, and one unknown word."""
    train = [(k, t) for k, t in enumerate(["a b a c", "a b d", "b a a a b", "c"] * 30)]
    vocab = ["a", "b", "c", "d"]
    # a held-out text per continuation: two texts differ in what follows "a"
    probe = [(1000 + k, f"a {w}".strip()) for k, w in enumerate([*vocab, "", "unknown"])]
    df = spark.createDataFrame(train + probe, "doc_id long, text string")
    score = {r.doc_id: r.score for r in hpylm.score(df, F.col("doc_id") >= 1000).collect()}
    # and the text "a w" ends with a mark after w, whose probability the text "w w" gives with the same first step
    ends = spark.createDataFrame(train + [(2000 + k, w) for k, w in enumerate([*vocab, "unknown"])], "doc_id long, text string")
    alone = {r.doc_id: r.score for r in hpylm.score(ends, F.col("doc_id") >= 2000).collect()}
    first = hpylm_first(df, spark, vocab)
    total = 0.0
    for k, w in enumerate([*vocab, "", "unknown"]):
        after = score[1000 + k] - first["a"]
        if w:
            after -= alone[2000 + [*vocab, "unknown"].index(w)] - first[w]
        total += 10 ** after
    assert math.isclose(total, 1, rel_tol=1e-6)


def hpylm_first(df, spark, vocab):
    """log10 probability of each word at the start of a text: that of the text
    "w" less that of the end after w, which "a w" and "a" do not give alone, so
    it is computed from the operator's parts on one block."""
    train = df.where("doc_id < 1000").select("doc_id", F.col("text").alias("_text"), F.lit(False).alias("_held"))
    probe = spark.createDataFrame([(1, w) for w in [*vocab, "unknown"]], "doc_id long, text string")
    both = train.unionAll(probe.select("doc_id", "text", F.lit(True))).coalesce(1)
    row = next(iter(wordblocks.blocks(both, "_text", ["doc_id", "_held"], True, hashed=True).collect())).asDict()
    b = wordblocks.Block(row)
    t = hpylm.Tokens(b)
    told = hpylm.Told.__new__(hpylm.Told)
    told.count, told.pair_count, told.owner, told.sums, told.seated = t.count, t.pair_count, np.ones(len(t.pairs), bool), {}, {0: np.minimum(t.pair_count, 1)}
    ones, twos = (t.pair_count == 1).sum(), (t.pair_count == 2).sum()
    v = int((t.count[:-1] > 0).sum())
    seats = hpylm.Seating(hpylm._discount(ones, twos), 0.5, v + 1, [])
    for s in range(hpylm.SAMPLES + 1):
        own = told.seated[s] = seats.pair_tables(s, t, told)
        sums = tuple(np.bincount(x, weights=own, minlength=len(t.words)).astype(np.int64) for x in (t.word, t.context))
        if s == 0:
            seats.word_discount = hpylm._discount((sums[0] == 1).sum(), (sums[0] == 2).sum())
        told.sums[s] = *sums, seats.word_tables(s, sums[0], t.words)
        seats.scalars.append((int(sums[0].sum()), int(told.sums[s][2].sum())))
    p = np.mean([seats.probability(s, t, told) for s in range(1, hpylm.SAMPLES + 1)], axis=0)
    first = t.ends - t.size
    return {w: math.log10(p[t.pair[first[len(first) - len(vocab) - 1 + k]]]) for k, w in enumerate([*vocab, "unknown"])}


def test_table_counts_follow_the_exact_conditional():
    """Up to EXACT customers: against weights of all seatings, enumerated."""
    d, theta, others, parent, c = 0.6, hpylm.STRENGTH, 3, 0.05, 5

    def seatings(sizes, left, weight):
        if not left:
            yield len(sizes), weight
            return
        for i, s in enumerate(sizes):
            yield from seatings([*sizes[:i], s + 1, *sizes[i + 1:]], left - 1, weight * (s - d))
        yield from seatings([*sizes, 1], left - 1, weight * (theta + d * (others + len(sizes))) * parent)

    want = np.zeros(c + 1)
    for t, w in seatings([], c, 1.0):
        want[t] += w
    want /= want.sum()
    n = 40_000
    names = np.random.default_rng(0).integers(1, 1 << 62, n).astype(np.uint64)
    got = hpylm.draw_tables(np.full(n, c), names, 1, d, np.full(n, others), np.full(n, parent))
    assert np.abs(np.bincount(got, minlength=c + 1) / n - want).max() < 0.01


def test_many_customers_follow_the_exact_conditional():
    """Beyond EXACT customers: against the Stirling numbers of all of them."""
    n = 4000
    names = np.random.default_rng(1).integers(1, 1 << 62, n).astype(np.uint64)
    for d, others, parent, c in ((0.5, 40, 0.01, 1500), (0.8, 3000, 0.002, 900), (0.8, 20, 1e-5, 400)):
        s = np.full(c + 2, -np.inf)
        s[1] = 0
        t = np.arange(1, c + 1)
        for k in range(1, c):
            s[1:-1] = np.logaddexp(s[:-2], np.log(np.maximum(k - d * t, 1e-300)) + s[1:-1])
        w = np.cumsum(np.log(hpylm.STRENGTH + d * (others + t - 1))) + t * math.log(parent) + s[1:-1]
        w = np.exp(w - w.max())
        want = (w * t).sum() / w.sum()
        got = hpylm.draw_tables(np.full(n, c), names, 2, d, np.full(n, others), np.full(n, parent))
        assert abs(got.mean() - want) < 0.1 * want, (d, got.mean(), want)


def exact_tables(d, others, parent, c, most):
    """Mean, deviation and weights of 1 to ``most`` tables, by the recursion."""
    s, t = np.full(most + 2, -np.inf), np.arange(1, most + 1)
    s[1] = 0
    for k in range(1, c):
        s[1:-1] = np.logaddexp(s[:-2], np.log(np.maximum(k - d * t, 1e-300)) + s[1:-1])
    w = np.cumsum(np.log(hpylm.STRENGTH + d * (others + t - 1))) + t * math.log(parent) + s[1:-1]
    w = np.exp(w - w.max())
    w /= w.sum()
    assert w[-1] < 1e-9
    mean = (w * t).sum()
    return mean, math.sqrt((w * (t - mean) ** 2).sum()), w


@pytest.mark.parametrize(("d", "others", "parent", "c"), [(0.8, 3000, 0.01, 1000), (0.8, 3000, 0.01, 20_000), (0.8, 20_000, 0.005, 1000), (0.8, 20_000, 0.005, 20_000),
                                                          (0.6, 100_000, 0.01, 20_000), (0.5, 30_000, 0.02, 1000), (0.9, 2000, 0.2, 20_000), (0.05, 3000, 0.05, 1000)])
def test_large_counts_of_many_tables_follow_the_exact_conditional(d, others, parent, c):
    mean, deviation, w = exact_tables(d, others, parent, c, min(c, 1500))
    n = 4000
    names = np.random.default_rng(3).integers(1, 1 << 62, n).astype(np.uint64)
    got = hpylm.draw_tables(np.full(n, c), names, 2, d, np.full(n, others), np.full(n, parent))
    assert mean > 25
    assert abs(got.mean() - mean) < 5 * deviation / math.sqrt(n), (got.mean(), mean)
    assert abs(got.std() - deviation) < 0.06 * deviation
    share = np.searchsorted(np.sort(got), np.arange(1, len(w) + 1), side="right") / n
    assert np.abs(share - np.cumsum(w)).max() < 0.035  # of the distribution, Kolmogorov's distance


def test_counts_are_packed_and_unpacked():
    for x in ([], [0, 1, 254], [255, 256, 3, 10**12], [255] * 9):
        x = np.array(x, np.int64)
        assert hpylm.unpack(hpylm.pack(x), len(x)).tolist() == x.tolist()


def test_empty_tables(spark, no_docs, docs):
    assert hpylm.score(no_docs, F.lit(True)).count() == 0
    rows = hpylm.score(docs, F.lit(True)).collect()  # nothing to learn from
    assert len(rows) == docs.count() and {r.train_tokens for r in rows} == {0} and {r.base_score for r in rows} == {0.0}


def test_hashes_are_ordered_also_where_their_high_bits_agree():
    rng = np.random.default_rng(4)
    for x in (np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 50, 5000).astype(np.uint64), np.array([3, 2, 1], np.uint64)):
        order = hpylm._order(x)
        assert (x[order] == np.sort(x)).all() and sorted(order.tolist()) == list(range(len(x)))


def test_near_peak_is_near():
    peak = np.array([1, 2, 10, 77, 1000, 5000])
    got = hpylm._near_peak(np.array([1, 100, 100, 100, 20_000, 5000]), lambda k, t: t >= peak[k])
    assert (np.abs(got - peak) <= np.sqrt(peak) + 1).all()
