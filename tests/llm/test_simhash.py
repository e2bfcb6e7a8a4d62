"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from odd import no_docs, odd_docs  # noqa: F401  fixtures
from taxomatch.llm import simhash
from taxomatch.llm.components import components, forest


def plain_fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.fp % (1 << 64)) for r in simhash.fingerprints(odd_docs, 3).collect())
    assert got == sorted((str(r.doc_id), plain_fingerprint(r.text, 3)) for r in rows)


@pytest.mark.parametrize("radius,tile", [(2, 4096), (2, 7), (3, 50), (0, 4096)])
def test_links_find_every_pair(spark, radius, tile):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(fps):
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= radius]
    want = plain_components(near, signed)
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, tile)
    got = {r.node: r.component for r in components(found).collect()}
    linked = {x for p in near for x in p}
    assert got == {n: c for n, c in want.items() if n in linked}


def test_near_duplicates_of_odd_rows(odd_docs):
    got = simhash.near_duplicates(odd_docs, 3, 2).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fps = {plain_fingerprint(r.text, 3) for r in rows}
    label = plain_components([(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2], fps)
    least = {}
    for r in rows:
        c = label[plain_fingerprint(r.text, 3)]
        least[c] = min((x for x in (least.get(c), r.doc_id) if x is not None), default=None)
    want = sorted((str(r.doc_id), f"{plain_fingerprint(r.text, 3):016x}", str(least[label[plain_fingerprint(r.text, 3)]])) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_one_of_each_keeps_null_and_repeated_ids_apart(spark):
    text = "one two three four five six seven"
    rows = [(5, text, 1), (5, text.upper(), 2), (None, "quite another text is standing here", 3), (2, text, 4), (7, None, 5), (8, "", 6)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _row long")).collect()
    assert sorted((r.doc_id or 0, r._row) for r in kept) == [(0, 3), (2, 4), (7, 5)]


def test_empty_tables(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_components_of_long_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(0, 400)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    odd = [(5000, 5000), (None, 3), (7001, 7000), (7000, 7001)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*path, *star, *odd], "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(401)}, **{1000 + k: 1000 for k in range(300)}, 7000: 7000, 7001: 7000}


def test_forest_connects_the_same():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 40, (2, rng.integers(0, 60)))
        u, v = forest(40, a, b)
        assert len(u) < 40
        assert plain_components(zip(a.tolist(), b.tolist()), range(40)) == plain_components(zip(u.tolist(), v.tolist()), range(40))
