"""Lattice near-duplicates and block search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxomatch.llm import lattice, nearest


def test_shortest_vectors_and_decoder():
    roots = lattice.shortest()
    assert roots.shape == (240, 8) and np.allclose((roots ** 2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(0, 1.5, (500, 8))
    home = lattice.decode(x)
    # lattice points: all integer or all half-integer, even sum
    assert np.isin((2 * home) % 2, (0, 1)).all() and (np.ptp((2 * home) % 2, axis=1) == 0).all() and (home.sum(axis=1) % 2 == 0).all()
    d = ((x - home) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()
    assert (d[:, None] <= ((x[:, None] - home[:, None] - roots) ** 2).sum(axis=2) + 1e-9).all()


def test_cells_do_not_depend_on_the_batch():
    x = lattice.unit_rows(np.random.default_rng(1).normal(size=(300, 64)))
    whole = lattice.cells(x, 3, 6, 0.16, 8)
    assert (whole == np.concatenate([lattice.cells(x[k:k + 7], 3, 6, 0.16, 8) for k in range(0, 300, 7)])).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = lattice.unit_rows(rng.normal(size=(3000, 64)))
    n = rng.normal(size=a.shape)
    n = lattice.unit_rows(n - (n * a).sum(axis=1, keepdims=True) * a)
    b = a * 0.951 + n * np.sqrt(1 - 0.951 ** 2)
    ca, cb = (lattice.cells(x, lattice.TABLES, lattice.PROBES, lattice.CELL, 8) for x in (a, b))
    met = (ca[:, :, :1] == cb).any(axis=2) | (cb[:, :, :1] == ca).any(axis=2)
    assert met.any(axis=1).mean() > 0.98


def odd_vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16)).astype(np.float32)
    near = np.concatenate([base[k:k + 1] + rng.normal(0, s, (8, 16)) for k, s in ((0, 0.05), (1, 0.1), (2, 0.2))]).astype(np.float32)
    crowd = (base[3] + rng.normal(0, 0.02, (70, 16))).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate([*base, *near, *crowd, 3 * base[5], base[6], base[6]])]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    rows += [(n + k, v) for k, v in enumerate(bad)]
    return rows + [(n + 50, [1.0, 2.0, 3.0]), (n + 51, [1.0, 2.0, 3.0]), (100, base[10].tolist()), (100, base[11].tolist()), (None, base[12].tolist())]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def cosine(x, y):
    x, y = np.array(x, float), np.array(y, float)
    return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))) if len(x) == len(y) else -2.0


@pytest.mark.parametrize("tile", [2048, 9])
def test_lattice_counts_links_and_components(spark, tile):
    rows = odd_vectors()
    df = spark.createDataFrame([(k, v, 0.5) for k, v in rows], "vec_id long, embedding array<float>, n_links double")
    got = sorted(((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.near_duplicates(df, 0.95, tile=tile, tables=8, probes=30).collect()))
    links = [[j for j, (_, w) in enumerate(rows) if j != i and usable(v) and usable(w) and cosine(v, w) >= 0.95] for i, (_, v) in enumerate(rows)]
    comp = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(links):
            for j in js:
                comp[i] = comp[j] = min(comp[i], comp[j])
    least = {c: min((k for (k, _), d in zip(rows, comp) if d == c and k is not None), default=None) for c in comp}
    want = sorted((str(k), len(links[i]), str(least[comp[i]]), k == least[comp[i]]) for i, (k, _) in enumerate(rows))
    assert got == want


def test_block_search_is_exact(spark):
    rows = [r for r in odd_vectors() if r[0] != 100] + [(100, odd_vectors()[0][1]), (100, odd_vectors()[0][1])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, score string")
    got = nearest.nearest(df, F.col("vec_id") % 10 == 0, 5, query_rows=4, candidate_rows=13).collect()
    good = [(k, v) for k, v in rows if usable(v) and k is not None]
    want = []
    for at, (q, x) in enumerate(good):
        found = sorted((-cosine(np.float32(x), np.float32(v)), k) for i, (k, v) in enumerate(good) if i != at and len(v) == len(x))[:5]
        want += [(q, n, k) for n, (s, k) in enumerate(found, 1) if q % 10 == 0]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)


def test_error_bound_holds():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 64)), rng.normal(size=(300, 64)) * 100
    (cx, sx, ex), (cy, sy, ey) = nearest.quantise(x), nearest.quantise(y)
    tile = (cx.astype(float) @ cy.astype(float).T) * sx[:, None] * sy
    true = lattice.unit_rows(x) @ lattice.unit_rows(y).T
    bound = np.multiply.outer(1 + ex, ey) + np.multiply.outer(ex, 1 + ey) + np.multiply.outer(ex, ey)
    assert (np.abs(tile - true) <= bound).all() and bound.max() < 0.1


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    none = df.limit(0)
    assert nearest.nearest(none, F.lit(True)).count() == 0 and lattice.near_duplicates(none).count() == 0


def test_rows_that_share_an_id_are_candidates_of_each_other(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [1.0, 0.3]), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == sorted([(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 0), (0, 1, 2), (0, 2, 1), (0, 3, 1), (0, 4, 0)])
