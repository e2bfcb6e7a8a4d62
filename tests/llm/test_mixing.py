"""The mix against a plain model of targets, draws and epochs."""

import random
from collections import Counter

import pytest

from odd import no_docs, odd_docs  # noqa: F401  fixtures
from taxomatch.llm import mixing
from taxomatch.llm.mixing import PRIME, ROUNDS


def shares(sizes, most=3):
    """Targets by resharing what stops, round by round."""
    weight = [1 + k % 3 for k in range(len(sizes))]
    total, stopped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in stopped)
        by = sum(w for k, w in enumerate(weight) if k not in stopped)
        new = {k for k in range(len(sizes)) if k not in stopped and weight[k] * left > most * sizes[k] * by}
        if not new or not total:
            return [float(most * s) if k in stopped else weight[k] * left / max(1, by) for k, s in enumerate(sizes)]
        stopped |= new


def make(spark, seed, n=400, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = "big" if rng.random() < hot else rng.choice(["a", "b", "é", "", None, "𝒳", "ﬀ", "tiny"])
        words = 0 if rng.random() < 0.1 else rng.choice([1, 3, 40, 900]) if source != "tiny" else 1
        rows.append((rng.randint(0, n) if rng.random() < 0.9 else None, None if rng.random() < 0.03 else " ".join(["w"] * words), source, "clash", 1))
    rows += rows[:20]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string, row int").repartition(4)


def in_order(names):
    return sorted(names, key=lambda s: (s is None, [ord(c) for c in s or ""]))


@pytest.mark.parametrize("seed,block", [(1, 16), (2, 64)])
def test_targets_are_met_and_nothing_is_taken_too_often(spark, seed, block):
    rows, docs = make(spark, seed)
    m = mixing.mix(docs, block=block, shard=32)
    size = Counter()
    for _, text, source, *_ in rows:
        size[source] += len((text or "").split())
    names = in_order(size)
    want = dict(zip(names, shares([size[s] for s in names]), strict=True))
    sources = {r.name: r for r in m.sources.collect()}
    assert {s: (r.size, r.target) for s, r in sources.items()} == {s: (size[s], want[s]) for s in names}
    number = {r.source: s for s, r in sources.items()}
    slots = m.slots.collect()
    assert sorted(r.shard * 32 + r.slot for r in slots) == list(range(len(slots)))
    words, epochs = Counter(), {}
    for r in slots:
        words[number[r.source]] += r.words
        epochs.setdefault((r.source, r.epoch), []).append(r.block)
        assert 0 < r.words <= block and r.epoch < 3
    assert all(words[s] == int(want[s]) for s in names)
    assert all(len(b) == len(set(b)) for b in epochs.values())  # a permutation: no block twice in an epoch
    got = Counter()
    held = {r.row: r for r in m.documents.collect()}
    inside = Counter()
    for r in m.pieces().collect():
        assert 0 <= r["first"] and r["first"] + r.words <= held[r.row]["size"]
        got[r.row] += r.words
        inside[r.shard * 32 + r.slot] += r.words
    assert {r.shard * 32 + r.slot: r.words for r in slots} == dict(inside)  # every slot is filled by documents
    assert all(got[k] <= 3 * r["size"] for k, r in held.items())
    out = mixing.taken(docs, block=block, shard=32).collect()
    assert len(out) == len(rows) and sum(r.taken for r in out) == sum(words.values())
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r["size"], r.target, r.taken)
    again = mixing.taken(docs.repartition(7), block=block, shard=32).collect()
    assert sorted(map(key, out)) == sorted(map(key, again))  # reruns agree, however the rows come


def test_permutation_is_a_bijection_and_draws_are_spread(spark):
    for n in (1, 2, 7, 100, 1013):
        rows = spark.range(n).selectExpr("id", f"cast({n} as long) as n", "cast(12345 as long) as seed")
        got = [r[0] for r in rows.select(mixing.permuted(rows["id"], rows["n"], rows["seed"])).collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or sum(a == b for a, b in enumerate(got)) < n / 10)
    from pyspark.sql import functions as F

    got = Counter(r[0] // 100 for r in spark.range(20_000).select(mixing.drawn(F.col("id"), F.lit(1000).cast("long"))).collect())
    assert len(got) == 10 and all(1800 < c < 2200 for c in got.values())
    assert all(0 < c < PRIME for c in ROUNDS)


def test_shards_draw_multinomially(spark):
    """Counts of a source in a shard vary as draws do, around the source's share."""
    rows = [(k, " ".join(["w"] * 64), "ab"[k % 2]) for k in range(600)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=4, shard=64)
    n = Counter((r.shard, r.source) for r in m.slots.collect())
    first = [n[s, 0] for s in range(max(s for s, _ in n))]
    mean = sum(first) / len(first)
    assert 18 < mean < 25 and 2 < (sum((x - mean) ** 2 for x in first) / len(first)) ** 0.5 < 6  # 64 draws at a third


def test_odd_tables(spark, odd_docs, no_docs):  # noqa: F811
    assert mixing.taken(no_docs.selectExpr("*", "'s' as source")).count() == 0
    docs = odd_docs.selectExpr("*", "if(doc_id % 2 = 0, null, 's') as source")
    out = mixing.taken(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in out)
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.taken(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_plan_is_native(spark):
    from taxomatch.llm.queries import op13_weighted_mix

    plan = op13_weighted_mix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
