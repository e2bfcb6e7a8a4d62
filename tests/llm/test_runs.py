"""Periodic runs against a search of every lag."""

import hashlib
import random

import numpy as np
import pytest

from odd import no_docs, odd_docs  # noqa: F401  fixtures
from taxomatch.llm import runs
from taxomatch.llm.queries import planted_period


def every_lag(w, min_words=24, times=3):
    """All maximal stretches of every lag; the smallest lag of equal ones."""
    n, seen = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, times * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def docs_of(rng):
    docs = []
    for _ in range(rng.randint(1, 5)):
        kinds, n = rng.choice([1, 2, 3, 50]), rng.randint(0, 250)
        w = [rng.randint(0, kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 3 else 0):
            s = rng.randrange(n)
            p = rng.randint(1, (n - s) // 3 + 1)
            for i in range(s + p, min(n, s + rng.randint(1, n))):
                w[i] = w[i - p]
        docs.append(w)
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_search_of_every_lag(seed):
    rng = random.Random(seed)
    for _ in range(100):
        docs = docs_of(rng)
        low, times = rng.choice([(24, 3), (24, 3), (3, 3), (10, 4)])
        at, found = runs.runs(np.array([x for d in docs for x in d], np.int64), [len(d) for d in docs], low, times)
        got = [[] for _ in docs]
        for d, r in zip(at.tolist(), found, strict=True):
            got[d].append(r)
        assert got == [every_lag(d, low, times) for d in docs]


def test_k_grams_that_repeat_inside_the_period():
    a, b = list(range(20)), list(range(100, 120))
    w = sum([a if c == "a" else b for c in "aaabbabb" * 4], [])
    found = runs.runs(np.array(w), [len(w)])[1]
    assert (0, 640, 160) in found and found == every_lag(w)


def test_seeds_stay_linear_in_one_long_run():
    at = np.arange(50_000)
    key = np.zeros(len(at), np.uint64)
    for lo, hi, k in runs.bands(24, 3, 10_000):
        assert len(runs._seeds(key, at, lo, hi, k)[0]) <= 4 * len(at)
    assert runs.runs(np.zeros(200_000, np.int64), [200_000])[1] == [(0, 200_000, 1)]


def test_operators(spark, odd_docs, no_docs):  # noqa: F811
    want = {}
    for r in odd_docs.select("doc_id", "text").collect():
        w = [x.decode() for x in (r.text or "").encode().split()]
        found = every_lag(w, 4, 3) if len(w) < 1000 else None
        want.setdefault(r.doc_id, []).append((w, found))
    known = {k for k, v in want.items() if all(f is not None for _, f in v)}
    got = {}
    for r in runs.find_runs(odd_docs, 4, 3).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.period))
    assert all(sorted(got.get(k, [])) == sorted(x for _, f in want[k] for x in f) for k in known)
    texts = {}
    for r in runs.collapse_runs(odd_docs, 4, 3).collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    sha = {}
    for r in runs.run_digests(odd_docs, 4, 3).collect():
        sha.setdefault(r.doc_id, []).append((r.n_runs, r.collapsed_sha256))
    assert texts.keys() == sha.keys() == want.keys()
    for k in known:
        kept = []
        for w, f in want[k]:
            gone = {i for s, n, q in f for i in range(s + q, s + n)}
            kept.append(" ".join(x for i, x in enumerate(w) if i not in gone))
        assert sorted(texts[k]) == sorted(kept)
        assert sorted(sha[k]) == sorted((len(f), hashlib.sha256(t.encode()).hexdigest()) for (_, f), t in zip(want[k], kept, strict=True))
    for f in (runs.find_runs, runs.collapse_runs, runs.run_digests):
        assert f(no_docs).count() == 0


def test_leading_run_and_ties():
    assert runs.leading([]) is None
    assert runs.leading([(9, 30, 5), (3, 60, 10), (3, 24, 8)]) == (3, 60, 10)  # both six times: the first start
    assert runs.leading([(0, 10**6 * 3 + 1, 10**6), (5, 3, 1)])[0] == 0  # exact, not rounded


def test_planted_period():
    words = [str(i).encode() for i in range(40)]
    ids = [d for d in range(400) if planted_period(d, words) != words]
    assert ids and len(ids) < 80
    for d in ids:
        w = planted_period(d, words)
        assert len(w) == 40 and set(w) < set(words)
    assert planted_period(None, words) == words and planted_period(ids[0], []) == []
