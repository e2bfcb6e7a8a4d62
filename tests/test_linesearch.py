"""Exact line search of field weights against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxomatch.functions.vectors import FIELDS, normalized_weights
from taxomatch.operators import evaluate as ev
from taxomatch.operators import linesearch as line

KB = "code string, " + ", ".join(f"vec_{f} array<double>" for f in FIELDS)
Q = "vec array<double>, truth_code string"
BASE = normalized_weights(ev.SEARCH_BASELINE)


def make(spark, seed, items=7, rows=60, dim=5):
    """Small whole numbers, so that ties and equal points occur."""
    r = random.Random(seed)
    vec = lambda: [float(r.randint(-2, 2)) for _ in range(dim)]
    kb = [(f"c{k}", *[vec() if r.random() < 0.9 else [0.0] * dim for _ in FIELDS]) for k in range(items)]
    kb.append((f"c{items}", *kb[0][1:]))                           # equal to another item: ties everywhere
    qs = [(vec(), f"c{r.randrange(items + 1)}") for _ in range(rows)]
    qs += [qs[0], qs[0], (None, "c1"), ([1.0] * dim, "not there"), ([1.0] * dim, None)]
    return kb, qs, spark.createDataFrame(kb, KB), spark.createDataFrame(qs, Q).repartition(3)


def hits_at(kb, qs, weights):
    """Top-1 hits by the definition, lowest code first on ties."""
    unit = lambda v: np.array(v) / np.linalg.norm(v) if np.linalg.norm(v) > 0 else np.zeros(len(v))
    hits = 0
    for v, truth in qs:
        if truth not in {r[0] for r in kb}:
            continue
        q = unit(v if v is not None else [0.0] * len(kb[0][1]))
        scores = [(-round(sum(w * float(q @ unit(f)) for w, f in zip(weights, r[1:])), 12), r[0]) for r in kb]
        hits += min(scores)[1] == truth
    return hits


def events(kb, q, blocked, weights=BASE):
    slab, n, dim = ev._kb_fields(kb, 1 << 30, blocked)
    if blocked:
        return line.events_blocked(q, ev.one_per_code(kb), weights, "truth_code", n, dim, ev.FieldSlab, 50, 3, 20)
    return line.events_broadcast(q, q.sparkSession.sparkContext.broadcast(slab), weights, "truth_code", dim, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_piece_has_the_hits_of_brute_force(spark, seed):
    kb, qs, kbf, qf = make(spark, seed)
    got = line.pieces(events(kbf, qf, False)).collect()
    checked = 0
    for p in got:
        if p.length < line.MIN_PIECE:
            continue
        for share in ((p.point + p.length * x) / line.GRID for x in (0.01, 0.5, 0.99)):
            assert hits_at(kb, qs, line.moved(BASE, p.field, share)) == p.hits, (p, share)
            checked += 1
    assert checked > 100
    for f in range(6):  # outside every piece nobody hits
        inside = [(p.point, p.point + p.length) for p in got if p.field == f]
        for share in np.linspace(0.0013, 0.9987, 40):
            if not any(a <= share * line.GRID <= b for a, b in inside):
                assert hits_at(kb, qs, line.moved(BASE, f, float(share))) == 0


def test_blocked_equals_broadcast(spark):
    _, _, kbf, qf = make(spark, 3)
    both = [{(r.field, r.point): r.d for r in events(kbf, qf, b).groupBy("field", "point").agg(F.sum("delta").alias("d")).collect()} for b in (False, True)]
    assert both[0] == both[1] and len(both[0]) > 20


def test_pieces_cross_buckets_of_points(spark):
    """A piece that spans many buckets, and buckets without a point."""
    rows = [(0, 0, 5), (0, 3 << 20, -2), (0, (3 << 20) + 7, 1), (0, line.GRID, -4), (2, 10, 1), (2, line.GRID, -1)]
    got = sorted(tuple(r) for r in line.pieces(spark.createDataFrame(rows, line.EVENTS)).collect())
    assert got == [(0, 0, 3 << 20, 5), (0, 3 << 20, 7, 3), (0, (3 << 20) + 7, line.GRID - (3 << 20) - 7, 4), (2, 10, line.GRID - 10, 1)]
    assert line.best_piece(spark.createDataFrame(rows, line.EVENTS)) == (0, (3 << 20) // 2 // 1000 * 1000 / line.GRID, 5)
    assert line.best_piece(spark.createDataFrame([], line.EVENTS)) is None


@pytest.mark.parametrize("blocked", [False, True])
def test_search_climbs_from_the_best_candidate(spark, blocked):
    kb, qs, kbf, qf = make(spark, 4)
    got = ev.weight_search(qf, kbf, candidates=5, rounds=4, force_blocked=blocked, kb_block_rows=3, query_block_rows=20).collect()
    weights = tuple(r.weight for r in got)
    rows = sum(t in {r[0] for r in kb} for _, t in qs)
    start = max(hits_at(kb, qs, normalized_weights(c)) for c in [ev.SEARCH_BASELINE, *ev.candidate_weights(5)])
    assert abs(sum(weights) - 1) < 1e-9 and min(weights) >= 0
    assert abs(got[0].accuracy - hits_at(kb, qs, weights) / rows) < 1e-12 and hits_at(kb, qs, weights) > start
    assert abs(got[0].baseline_accuracy - hits_at(kb, qs, BASE) / rows) < 1e-12


def test_a_single_weight_and_no_rows(spark):
    kb, qs, kbf, qf = make(spark, 5)
    single = (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)  # the others have no rest for field 0
    assert {r.field for r in events(kbf, qf, False, single).collect()} == {1, 2, 3, 4, 5}
    got = ev.weight_search(qf.where("false"), kbf, candidates=2).collect()
    assert [r.accuracy for r in got] == [0.0] * 6 and abs(sum(r.weight for r in got) - 1) < 1e-9
