"""Recompression against counting every window."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from odd import no_docs  # noqa: F401  fixtures
from taxomatch.llm import recompress, wordblocks


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_removed(texts, window):
    seen = collections.Counter(tuple(w[k:k + window]) for w in map(words_of, texts) for k in range(len(w) - window + 1))
    out = []
    for w in map(words_of, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append(gone)
    return out


def passages(window):
    rng = random.Random(window)
    vocab = [f"w{k}" for k in range(40)]
    make = lambda n, v=vocab: [rng.choice(v) for _ in range(n)]
    shared = make(window + 20)
    out = [" ".join(make(rng.randint(0, 60)) + shared[rng.randint(0, 10):rng.randint(window, window + 20)] + make(rng.randint(0, 60))) for _ in range(40)]
    out += [" ".join(make(rng.randint(0, 3 * window), v)) for v in (["a"], ["a", "b"], ["a", "b", "c"]) for _ in range(8)]
    out += [" ".join(["ha"] * (window + 1)), " ".join(["ho"] * window), " ".join(["hi"] * (window - 1) + ["b"]), " ".join(["hi"] * (window + 5)) + "\n b"]
    out += [None, "", " \n", out[0], out[0], "\t" + "\n".join(shared) + "  ", " ".join(make(20_000))]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(wordblocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(wordblocks, "BUCKET_WORDS", 5000)


@pytest.mark.parametrize("window", [35, 8])
def test_removal_equals_brute_force(spark, small_blocks, window):
    texts = passages(window)
    ids = [None if k % 13 == 0 else k % 50 for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n_removed string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in recompress.removal_digests(df, window).collect())
    want = []
    for i, t, gone in zip(ids, texts, plain_removed(texts, window)):
        kept = [w for w, g in zip(words_of(t), gone) if not g]
        want.append((str(i), len(gone), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert got == sorted(want)


def test_texts_without_repeats(spark, small_blocks):
    texts = passages(35)
    df = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, _c0 long, _text string")
    got = {r.doc_id: r for r in recompress.without_repeats(df, 35).collect()}
    assert len(got) == len(texts)
    for k, (t, gone) in enumerate(zip(texts, plain_removed(texts, 35))):
        r = got[k]
        assert (r._c0, r._text, r._removed) == (k, "x", sum(gone))
        if not any(gone):
            assert r.text == t
        else:
            assert words_of(r.text) == [w for w, g in zip(words_of(t), gone) if not g]


def test_certain_symbols_of_equal_windows_are_equal():
    rng = np.random.default_rng(7)
    names = rng.integers(1, 1 << 62, 50).astype(np.uint64)
    some = 0
    for kinds in (1, 2, 3, 50):
        for _ in range(20):
            common = rng.integers(0, kinds, 60)
            docs = [np.concatenate([rng.integers(0, kinds, rng.integers(0, 20)), common[rng.integers(0, 15):], rng.integers(0, kinds, rng.integers(0, 20))]) for _ in range(4)]
            ids, doc = np.concatenate(docs), np.repeat(np.arange(4), [len(d) for d in docs])
            top, first, end = recompress.parse(names[ids], doc, 35)
            seen = {}
            for i in range(len(ids) - 34):
                if doc[i] == doc[i + 34]:
                    certain = top[first[i]:end[i]].tolist() if first[i] < end[i] else []
                    assert seen.setdefault(tuple(ids[i:i + 35]), certain) == certain
                    some += bool(certain)
    assert some > 1000


def test_table_is_dropped_and_empty_input(spark, no_docs):
    assert recompress.removal_digests(no_docs).count() == 0
    assert recompress.without_repeats(no_docs).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("word_blocks")]


def test_blocks_are_not_shuffled_for_answers(spark):
    df = spark.createDataFrame([(k, f"some text {k}") for k in range(50)], "doc_id long, text string")
    with wordblocks.block_table(df, "text", ["doc_id"], False) as (table, buckets, _):
        q = wordblocks.answer(wordblocks.ask(table, lambda b: iter(()), recompress.QUESTION), recompress._shared, recompress.ANSWER)
        plan = wordblocks.with_answers(table, q, lambda b, a: a, recompress.ANSWER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # questions and answers
