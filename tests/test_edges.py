"""Edge cases found in review: ids, sizes and widths on both matcher paths,
cut values, reports, storage and the missing-subpackage guard."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from taxomatch.operators import evaluate as ev
from taxomatch.operators import labels as lb
from taxomatch.operators import report as rp
from taxomatch.operators.lexical import bm25_index, overlap_topk
from taxomatch.operators.match import MatchConfig, match, prepare, to_long, to_wide
from taxomatch.session import delete_scratch, ensure_checkpoint_dir, scratch_dir
from taxomatch.sources import tables as st

W = {"Tasks": 0.5, "Description": 0.5}
KB = "code string, title string, vec_task array<double>, vec_desc array<double>"


def kb_rows(spark, n):
    return spark.createDataFrame([(f"c{k}", f"T {k}", [1.0, k / 3, 0.0], [0.0, 1.0, float(k)]) for k in range(n)], KB)


def queries(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (1, [0.0, 0.0, 1.0], "b"), (None, [0.0, 1.0, 0.0], "c"), (None, None, "d"), (2, [1.0, 0.0, 0.0], "a")]
    return spark.createDataFrame(rows, "query_id long, vec array<double>, tag string").repartition(3)


def rows_of(df):
    return sorted((str(r.query_id), r.tag, tuple(r.codes), tuple(round(s, 9) for s in r.scores), tuple(round(s, 9) for s in r.raw_scores)) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 4, 9])
@pytest.mark.parametrize("block", [1, 3])
def test_both_paths_agree_on_ids_and_sizes(spark, n, block):
    kb, q = kb_rows(spark, n), queries(spark)
    fast = match(q, kb, MatchConfig(weights=W))
    blocked = match(q, kb, MatchConfig(weights=W, force_blocked=True, kb_block_rows=block, query_block_rows=2))
    assert rows_of(fast) == rows_of(blocked)
    assert all(len(r[2]) == min(3, n) for r in rows_of(fast)) and len(rows_of(fast)) == 5
    for variant in ("production", "eval", "app"):
        assert to_wide(blocked, variant).count() == 5


def test_both_paths_agree_with_bm25_and_boost(spark):
    corpus = spark.createDataFrame([(f"c{k}", f"w{k} w{k % 2} common") for k in range(5)], "code string, text string")
    kb = kb_rows(spark, 5).join(bm25_index(corpus), "code").withColumn("title_words", F.array("title"))
    q = queries(spark).withColumn("tokens", F.array(F.lit("w1"), F.lit("common"), F.lit("nothing"))).withColumn("title_words", F.array(F.lit("T 3")))
    cfg = {"weights": W, "bm25_weight": 0.3, "title_boost": 0.1}
    assert rows_of(match(q, kb, MatchConfig(**cfg))) == rows_of(match(q, kb, MatchConfig(**cfg, force_blocked=True, kb_block_rows=2, query_block_rows=2)))


@pytest.mark.parametrize("force", [False, True])
def test_a_vector_of_another_width_is_an_error(spark, force):
    q = spark.createDataFrame([(1, [1.0, 0.0], "x")], "query_id long, vec array<double>, tag string")
    with pytest.raises(Exception, match="components"):
        match(q, kb_rows(spark, 3), MatchConfig(weights=W, force_blocked=force)).collect()


def test_overlap_join_equals_the_boost_of_the_matcher(spark):
    words = lambda *w: list(w)
    kb = spark.createDataFrame([(f"c{k}", f"T {k}", words("a", f"w{k % 3}", f"v{k}")) for k in range(7)], "code string, title string, title_words array<string>")
    q = spark.createDataFrame([(1, words("a", "w1", "a")), (2, words("v3", "w0")), (3, words("zzz")), (4, []), (5, None)], "query_id long, title_words array<string>")
    got = sorted((r.query_id, r["rank"], r.code, r.overlap) for r in overlap_topk(q, kb, 3).collect())
    r = to_long(match(q, kb, MatchConfig(weights={}, title_boost=1.0, k=3))).where("score > 0").collect()
    assert got == sorted((x.query_id, x["rank"], x.code, int(x.score)) for x in r) and got


def test_prepared_kb_is_closed(spark):
    p = prepare(kb_rows(spark, 3), MatchConfig(weights=W))
    assert len(rows_of(match(queries(spark), p))) == 5
    p.close()


@pytest.mark.parametrize("fields", [1, 2])
def test_weight_accuracy_paths_agree(spark, fields):
    kb = kb_rows(spark, 6).select("code", *["vec_task", "vec_desc"][:fields])
    kb = kb.unionAll(kb.where("code = 'c1'"))  # a repeated code
    q = spark.createDataFrame([(k % 3, [1.0, k / 3, 0.0], f"c{k}") for k in range(6)] + [(None, [0.0, 1.0, 1.0], "c1"), (9, [1.0, 1.0, 1.0], "unknown")],
                              "query_id long, vec array<double>, truth_code string")
    cands = [(1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0)]
    both = [sorted((r.candidate, r.hits, r.rows) for r in ev.weight_accuracy(q, kb, cands, force_blocked=f, kb_block_rows=b, query_block_rows=2).collect())
            for f, b in ((False, 1), (True, 1), (True, 4))]
    assert both[0] == both[1] == both[2] and both[0][0][2] == 7


def test_weight_search_takes_the_best(spark):
    kb = kb_rows(spark, 6)
    q = spark.createDataFrame([(k, [0.0, 1.0, float(k)], f"c{k}") for k in range(6)], "query_id long, vec array<double>, truth_code string")
    got = ev.weight_search(q, kb, candidates=20).collect()
    tried = [tuple(ev.SEARCH_BASELINE), *ev.candidate_weights(20)]
    acc = {r.candidate: r.accuracy for r in ev.weight_accuracy(q, kb, tried).collect()}
    assert len(got) == 6 and {r.accuracy for r in got} == {max(acc.values())} and {r.baseline_accuracy for r in got} == {acc[0]}
    assert abs(sum(r.weight for r in got) - 1) < 1e-9


@pytest.mark.parametrize("n,frac", [(0, 0.5), (1, 0.5), (7, 0.0), (7, 1.0), (1000, 0.37), (5000, 0.8)])
def test_first_rows_equal_a_sort(spark, n, frac):
    df = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(97)) - 40).alias("h"))
    got = {r.row_id for r in df.where(lb.first_rows(df, F.col("h"), "row_id", lambda k: int(k * frac))).collect()}
    rows = sorted(((r.h if r.h is not None else -10**9, r.row_id) for r in df.collect()))
    assert got == {i for _, i in rows[:int(n * frac)]}
    wide = df.withColumn("h", F.xxhash64("row_id"))  # the whole range of a long
    got = {r.row_id for r in wide.where(lb.first_rows(wide, F.col("h"), "row_id", lambda k: int(k * frac))).collect()}
    assert got == {r.row_id for r in sorted(wide.collect(), key=lambda r: (r.h, r.row_id))[:int(n * frac)]}


def test_ranks_beyond_one_bucket_take_nulls(spark):
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("x"), "id")
    a = {r.id: r.rn for r in lb.ranked(df, ["x", "id"], "rn").collect()}
    assert a == {r.id: r.rn for r in lb.ranked(df, ["x", "id"], "rn", rows_per_bucket=9).collect()}


def test_report_is_one_pass_over_the_matches(spark):
    rows = [("11-1", "Nurse", 70.1), ("11-1", "Nurse", 49.9), ("13-2", "Clerk", 60.0), ("99-9", "x" * 50, 60.0)]
    df = spark.createDataFrame(rows, "Matched_SOC_Code string, Matched_Title string, `Confidence_%` double")
    got = {(r.section, r.item): (r.n, r.value) for r in rp.report(df).collect()}
    assert got["summary", "rows"] == (4, 60.0) and got["tier", "Moderate"][0] == 2
    assert got["occupation", "Nurse"][0] == 2 and got["occupation", "x" * 35 + "…"][0] == 1
    assert got["group", "Management"] == (2, 60.0) and sum(n for (s, _), (n, _) in got.items() if s == "histogram") == 4


def test_sheets_and_null_values(spark, tmp_path):
    book = str(tmp_path / "book")
    st.write_delimited(spark.createDataFrame([("a", "NA"), ("b", "x\ny")], "k string, v string"), f"{book}/One.csv")
    assert [r.v for r in st.read_sheet(spark, book, "One", multi_line=True).orderBy("k").collect()] == ["NA", "x\ny"]
    with pytest.raises(FileNotFoundError, match="no sheet"):
        st.read_sheet(spark, book, "Two")
    got = st.read_delimited(spark, f"{book}/One.csv", sep=",", multi_line=True, na_values=("NA",)).orderBy("k").collect()
    assert [r.v for r in got] == [None, "x\ny"]


def test_shuffle_order_is_seeded(spark):
    df = spark.range(50)
    a, b, c = ([r.id for r in lb.shuffled(df, s, "id").orderBy("shuffle_order").collect()] for s in (1, 1, 2))
    assert a == b != c and sorted(a) == list(range(50))


def test_scratch_tables_are_deleted(spark):
    path = scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert delete_scratch(spark) >= 1 and not os.path.exists(path)


class _Cluster:
    """A session on a cluster, as far as the check looks."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

    class conf:  # noqa: N801
        @staticmethod
        def get(*_):
            return None


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster())


def test_entry_imports_without_the_optional_subpackage():
    code = ("import sys, json; sys.modules['taxomatch.llm'] = None; import __spark_entry__ as e; "
            "print(json.dumps(sorted(e.queries()))); print(sorted(set(e.oracle_sql()) - set(e.queries())))")
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=True).stdout.splitlines()
    names = json.loads(out[0])
    assert "match_topk" in names and "pipeline" not in names and not any(n.startswith("op") for n in names) and out[1] == "[]"
