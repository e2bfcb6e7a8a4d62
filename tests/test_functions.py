"""Golden cases for the column functions and small operators (hand-written)."""

import random
import textwrap

from pyspark.sql import functions as F

from taxomatch.functions import text as tx
from taxomatch.functions import vectors as vx
from taxomatch.operators import kb as kbo
from taxomatch.operators import labels as lb
from taxomatch.operators import report as rp
from taxomatch.operators.centroid import weighted_centroid
from taxomatch.operators.evaluate import eval_summary


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_importance_weight(spark):
    got = one_col(spark, [None, "", "nan", "abc", "1", "3", "5", "0", " 4 "], tx.importance_weight)
    assert got == [0.5, 0.5, 0.5, 0.5, 0.0, 0.5, 1.0, -0.25, 0.75]


def test_stemmer_keeps_reference_rule(spark):
    words = ["workers", "managers", "supervisors", "nurses", "gas", "bus", "users"]
    got = one_col(spark, words, lambda c: tx.stem(c))
    assert got == ["worke", "manage", "supervisor", "nurse", "gas", "bus", "user"]
    fixed = one_col(spark, ["workers"], lambda c: tx.stem(c, "fixed"))
    assert fixed == ["worker"]


def test_title_words(spark):
    got = one_col(spark, ["Managers, All Other of the Sales", "", None], lambda c: F.array_sort(tx.title_words(c)))
    assert got == [["managers,", "sale"], [], []]


def test_is_code_prefix(spark):
    got = one_col(spark, ["11-1021.00", "11-1021.00 extra", "11-1021", None, " 15-1252.00 "], tx.is_code)
    assert got == [True, True, False, False, True]


def test_major_group_and_tier(spark):
    assert one_col(spark, ["15-1252.00", "99-0000.00", None], tx.major_group) == ["Computer & Math", "Other", "Other"]
    got = one_col(spark, [65.0, 64.9, 50.0, 49.9], tx.confidence_tier, "double")
    assert got == ["High", "Moderate", "Moderate", "Low"]


def test_strip_and_tokens(spark):
    assert one_col(spark, ["\t a b \n"], tx.strip_ws) == ["a b"]
    assert one_col(spark, ["  A  b\nC "], tx.tokens) == [["a", "b", "c"]]
    assert one_col(spark, ["Manager", " Staff  Accountant "], tx.word_count) == [1, 2]


def test_chunk_text_matches_textwrap_on_single_spaced_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text", tx.chunk_text("text", 800).alias("chunks")).collect()
    checked = 0
    for r in rows:
        flat = " ".join((r["text"] or "").split())
        if "-" in flat:
            continue  # textwrap also breaks after hyphens; we do not
        assert r["chunks"] == textwrap.wrap(flat, 800), r["doc_id"]
        checked += 1
    assert checked > 100


def test_chunk_text_long_words(spark):
    text = "ab " + "x" * 25 + " cd ef"
    got = one_col(spark, [text], lambda c: tx.chunk_text(c, 10))[0]
    assert got == textwrap.wrap(text, 10)
    assert one_col(spark, ["", None, "   "], lambda c: tx.chunk_text(c, 10)) == [[], [], []]


def test_swap_repair_variants(spark):
    rows = [(1, "Nurses", "29-1141.00"), (2, "29-1141.00", "Nurses"), (3, "x", "y"), (4, "", "11-1021.00")]
    df = spark.createDataFrame(rows, "row_id int, onet_soc string, onet_title string")
    ev = {r["row_id"]: (r["onet_soc"], r["swapped"]) for r in lb.swap_repair(df).collect()}
    assert ev == {1: ("29-1141.00", True), 2: ("29-1141.00", False), 4: ("11-1021.00", True)}
    tr = {r["row_id"] for r in lb.swap_repair(df, pre_filter=True).collect()}
    assert tr == {1, 2}


def test_flatten_text(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("a", "y", 3), ("b", None, 1), (None, "z", 1)],
                               "code string, text string, seq int")
    got = {r["code"]: r["flat"] for r in kbo.flatten_text(df, "code", "text", "flat").collect()}
    assert got == {"a": "x | y", "b": ""}


def test_guess_column():
    assert lb.guess_column(["ID", "Role", "Job Desc"], lb.TITLE_KEYWORDS) == "Job Desc"
    assert lb.guess_column(["ID", "Notes"], lb.DESC_KEYWORDS) is None


def test_cosine_zero_vector_and_zero_weights(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vx.cosine("a", "b")).first()[0] == 0.0
    w = spark.createDataFrame([("k", [1.0, 2.0], 0.0), ("k", [3.0, 4.0], 0.0)], "key string, v array<double>, w double")
    assert weighted_centroid(w, "key", "v", "w", "c").first()["c"] == [0.0, 0.0]


def test_eval_summary_without_codes(spark):
    df = spark.createDataFrame([(None, None, 40.0)], "Correct int, Correct_Top3 int, Machine_Confidence double")
    r = eval_summary(df).first()
    assert r["n"] == 0 and r["top1_pct"] is None and r["no_code"] == 1


def test_histogram_all_equal(spark):
    df = spark.createDataFrame([(50.0,), (50.0,), (50.0,)], "`Confidence_%` double")
    h = rp.histogram(df, "Confidence_%", 20).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 3 and sum(1 for r in h if r["count"]) == 1
    assert h[0]["lo"] == 49.5 and h[-1]["hi"] == 50.5


def test_normalized_weights():
    w = vx.normalized_weights((-2, 1, 0, 3, 0.5, 0))
    assert abs(sum(w) - 1.0) < 1e-12 and w[0] == 2 / 6.5
    assert vx.normalized_weights((0,) * 6) == (0.0,) * 6


def test_profile_is_whole_unless_capped(spark):
    long = "x" * 900
    df = spark.createDataFrame([("T", long, long, None), (" T ", "", None, long)], "t string, d string, a string, s string")
    whole = [r[0] for r in df.select(tx.profile_text("t", "d", "a", "s")).collect()]
    assert whole == [f"T {long} {long}", f"T  {long}"]
    cut = [r[0] for r in df.select(tx.profile_text("t", "d", "a", "s", caps=(None, 400, 200, 300))).collect()]
    assert cut == [f"T {long[:400]} {long[:200]}", f"T  {long[:300]}"]


def test_chunk_text_long_runs_match_textwrap(spark):
    import random

    rng = random.Random(12)

    def run():
        return "".join(rng.choice(["a", "b", "7", "-", "--", "x-y", "1-2", "ab-cd"]) for _ in range(rng.randint(1, 60)))

    rows = [(i, " ".join(rng.choice([run(), "the", "well-known", "z" * rng.randint(1, 50), "-" * rng.randint(1, 30)]) for _ in range(rng.randint(1, 8))),
             rng.randint(5, 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, t string, w int")
    for w in sorted({r[2] for r in rows}):
        for r in df.where(F.col("w") == w).select("t", tx.chunk_text("t", w, hyphens=True).alias("c")).collect():
            assert [c.strip() for c in r["c"]] == [c.strip() for c in textwrap.wrap(r["t"], w)], (w, r["t"])


def test_chunk_text_hyphen_breaks_match_textwrap(spark):
    import random

    rng = random.Random(11)
    vocab = ["well-known", "x-ray", "e-mail", "co-op", "long-term", "a-b-c", "self-driving", "state-of-the-art",
             "3-4", "ab-12", "the", "data", "re-enter", "über-cool", "a", "bb", "mid-", "-pre"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))), rng.randint(9, 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string, w int")
    for w in sorted({r[2] for r in rows}):
        got = df.where(F.col("w") == w).select("t", tx.chunk_text("t", w, hyphens=True).alias("c")).collect()
        for r in got:
            assert r["c"] == textwrap.wrap(r["t"], w), (w, r["t"])


def test_title_code_join_fanout_modes(spark):
    survey = spark.createDataFrame([(1, " Nurse "), (2, "clerk"), (3, None)], "id int, t string")
    tax = spark.createDataFrame([("29-1", "nurse"), ("29-2", "NURSE"), ("43-1", "Clerk")], "code string, title string")
    fan = sorted((r["id"], r["code"]) for r in kbo.title_code_join(survey, tax, "t", "title", "code").collect())
    assert fan == [(1, "29-1"), (1, "29-2"), (2, "43-1"), (3, None)]
    one = {r["id"]: (r["code"], r["codes"]) for r in kbo.title_code_join(survey, tax, "t", "title", "code", fanout=False).collect()}
    assert one == {1: ("29-1", ["29-1", "29-2"]), 2: ("43-1", ["43-1"]), 3: (None, None)}


def test_chunk_text_breaks_around_dash_runs_of_any_length(spark):
    rng = random.Random(3)
    texts = ["a " * 395 + "word" + "-" * n + "behind it " * 20 for n in (2, 999, 1000, 1001, 1700, 5000)]
    for _ in range(40):
        parts = [rng.choice(["x", "well-known", "a--b", "end.", "--", "-", "q" * 30, "don't---stop", "3--4"]) + rng.choice([" ", " ", "-" * rng.choice([1, 2, 1001, 1500])]) for _ in range(rng.randint(1, 60))]
        texts.append("".join(parts).strip())
    got = one_col(spark, texts, lambda c: tx.chunk_text(c, 80, hyphens=True))
    assert got == [textwrap.wrap(" ".join(t.split()), 80) for t in texts]
    assert one_col(spark, texts[:6], lambda c: tx.chunk_text(c, 800, hyphens=True)) == [textwrap.wrap(t, 800) for t in texts[:6]]
