"""Registered queries, their SQL, and the pipeline against brute force."""

import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import oracle_check as oc
from taxomatch.llm import quality
from taxomatch.llm.common import saved, table
from taxomatch.llm.queries import ORACLE_SQL, QUERIES
from test_recompress import plain_removed, words_of
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names
    assert set(ORACLE_SQL) <= set(e.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_sql(spark, key):
    msg, ok = oc.compare(spark, oc.duck(SF), key, QUERIES[key], ORACLE_SQL[key], SF)
    assert ok, msg


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as cp

    docs, out = table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage(spark, stages):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = rows(stages[0])
    scored = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, labels, quality.F.lit(True))).collect()}
    assert set(kept) == {d for d, p in scored.items() if p}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert good <= set(kept) and stages[0].columns == docs.columns


def test_simhash_stage(stages):
    before, after = rows(stages[0]), rows(stages[1])
    fp = {d: plain_fingerprint(r.text, 3) for d, r in before.items()}
    ids = sorted(before)
    label = plain_components([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    assert set(after) == set(label.values()) and all(after[d] == before[d] for d in after)


def test_substring_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert before.keys() == after.keys()
    for (d, r), gone in zip(before.items(), plain_removed([r.text for r in before.values()], 35)):
        if any(gone):
            assert words_of(after[d].text) == [w for w, g in zip(words_of(r.text), gone) if not g]
            assert after[d].n_chars == len(after[d].text)
        else:
            assert after[d] == r


def test_packing_stage(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in stages[3].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    want = rows(stages[2])
    assert pieces.keys() == want.keys()
    for d, r in want.items():
        ids = np.concatenate([p.ids for p in sorted(pieces[d], key=lambda p: p.start)])
        assert ids.tolist() == tok.encode(r.text or "", add_special_tokens=False).ids + [1]


def test_run_returns_the_last_stage(spark, stages):
    import corpus_pipeline as cp

    cols = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    got = cp.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()
    assert sorted(map(tuple, got)) == sorted({(r.doc_id, r.doc_tokens) for r in stages[3].select(*cols).collect()})


def test_entry_without_the_subpackage(monkeypatch):
    """The other queries stand when the subpackage is gone."""
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("taxomatch.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "taxomatch.llm", None)
    import __spark_entry__ as e

    assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_substring_stage_with_clashing_names_nulls_and_repeats(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, 3, "a"), (1, long, 4, None), (None, None, None, "b"), (2, "", 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _removed long, _text string")
    got = sorted(((r.doc_id or 0, r.text, r["_removed"], r["_text"]) for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, "", 3, "a"), (1, "", 4, None), (0, None, None, "b"), (2, "", 0, "c")], key=repr)


def test_null_id_is_held_out_of_nothing(spark, tmp_path):
    from taxomatch.llm.queries import op10_subword_quality

    docs = [(k, f"{'good clean prose' if k % 2 else 'zz zz qq'} {k}") for k in range(60)] + [(None, "good clean prose")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op10_subword_quality(spark, str(tmp_path)).collect()}
    assert got[None].held_out is False and len(got) == 61
