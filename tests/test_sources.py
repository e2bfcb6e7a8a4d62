"""Scans, weights file and vector cache."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from taxomatch.functions.vectors import TUNED_WEIGHTS
from taxomatch.plans import standins as si
from taxomatch.sources import tables as st
from taxomatch.sources.vector_cache import cache_key, read_vector_cache, write_vector_cache


def test_missing_file_gives_empty_table(spark):
    df = st.read_delimited(spark, "/nonexistent/path/file.txt", ["a", "b"])
    assert df.columns == ["a", "b"] and df.count() == 0


def test_quotes_newlines_and_blanks_round_trip(spark):
    path = tempfile.mkdtemp(prefix="taxomatch-csv-") + "/t"
    rows = [(1, 'say "hi"\nnext line', "  padded  "), (2, "", None)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    st.write_delimited(df, path, sep="\t")
    back = st.fill_blank(st.read_delimited(spark, path, ["id", "a", "b", "zzz"], sep="\t", multi_line=True))
    got = sorted(tuple(r) for r in back.collect())
    assert got == [("1", 'say "hi"\nnext line', "  padded  "), ("2", "", "")]


def test_weights_defaults_and_unknown_fields(spark):
    path = tempfile.mkdtemp(prefix="taxomatch-w-") + "/w"
    spark.createDataFrame([("Tasks", "0.5"), ("Bogus", "9"), ("Tools", "abc")], "field string, weight string") \
        .coalesce(1).write.option("header", True).csv(path)
    w = st.weights_dict(st.read_weights(spark, path))
    assert w["Tasks"] == 0.5 and w["Tools"] == TUNED_WEIGHTS["Tools"] and "Bogus" not in w
    assert st.weights_dict(st.read_weights(spark, None)) == TUNED_WEIGHTS


def test_vector_cache_refuses_silent_overwrite(spark):
    root = tempfile.mkdtemp(prefix="taxomatch-vc-")
    kb = si.vector_kb(spark, SF001).select("code", "vec_task")
    write_vector_cache(kb, root, "BAAI/some model")
    with pytest.raises(FileExistsError):
        write_vector_cache(kb, root, "BAAI/some model")
    write_vector_cache(kb, root, "BAAI/some model", overwrite=True)
    assert read_vector_cache(spark, root, "BAAI/some model").count() == 10
    with pytest.raises(FileNotFoundError):
        read_vector_cache(spark, root, "other")
    assert cache_key("/abs/path to/model") == "_abs_path_to_model"


def test_strip_all_keeps_non_strings(spark):
    df = spark.createDataFrame([(1, "\t x \n")], "i int, s string")
    assert st.strip_all(df).first() == (1, "x")


def test_user_input_mock_is_opt_in(spark):
    with pytest.raises(FileNotFoundError):
        st.read_user_input(spark, "/nonexistent/users.csv")
    df = st.read_user_input(spark, "/nonexistent/users.csv", mock_if_missing=True)
    assert [r["User_Job_Title"] for r in df.orderBy("User_ID").collect()] == ["Budget Director", "Code Writer"]


def test_read_table_dispatch(spark):
    base = tempfile.mkdtemp(prefix="taxomatch-rt-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    df.write.json(f"{base}/t.json")
    df.write.parquet(f"{base}/t.parquet")
    st.write_delimited(df, f"{base}/t.csv", sep=",")
    st.write_delimited(df, f"{base}/t.tsv", sep="\t")
    for name in ("t.json", "t.parquet", "t.csv", "t.tsv"):
        got = sorted((str(r["id"]), r["s"]) for r in st.read_table(spark, f"{base}/{name}", ["id", "s", "nope"]).collect())
        assert got == [("1", "a"), ("2", "b")], name


def test_spread_input_only_for_large_single_partition_inputs(spark):
    from taxomatch.session import spread_input

    want = spark.sparkContext.defaultParallelism
    small = "/root/testdata/sf0.001/nation.parquet"
    df = spark.read.parquet(small)
    assert spread_input(df, small) is df                       # small file: unchanged
    big = "/root/testdata/sf0.1/lineitem.parquet"
    spread = spread_input(spark.read.parquet(big), big)
    assert spread.rdd.getNumPartitions() == want               # one row group -> spread
    many = spark.read.parquet(big).repartition(want + 1)
    assert spread_input(many, big) is many                      # already parallel: unchanged
    assert spread.count() == spark.read.parquet(big).count()


def _files(root, **texts):
    import os

    os.makedirs(root, exist_ok=True)
    for name, text in texts.items():
        with open(f"{root}/{name}.txt", "w", encoding="utf-8", newline="") as f:
            f.write(text)


def test_folder_of_files_with_headers_of_their_own(spark):
    root = tempfile.mkdtemp(prefix="taxomatch-mixed-")
    _files(root, one="a\tb\n1\t2\n3\n4\t5\t6\n", two="b\ta\n20\t10\n", three='﻿a\t"c ""x"""\n7\t"8\t8"\n', empty="", bare="b\ta\n")
    df = st.read_folder(spark, root, file="file")
    assert sorted(df.columns) == sorted(["a", "b", 'c "x"', "_malformed", "file"])
    got = sorted((r["a"], r["b"], r['c "x"'], r["_malformed"]) for r in df.collect())
    assert got == [("1", "2", None, None), ("10", "20", None, None), ("3", None, None, "3"), ("4", "5", None, "4\t5\t6"), ("7", None, "8\t8", None)]
    counts = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["malformed"]) for r in st.malformed_counts(df, "file").collect()}
    assert counts == {"one.txt": (3, 2), "two.txt": (1, 0), "three.txt": (1, 0)}
    # a malformed row is seen though its missing cell is not asked for
    narrow = st.read_folder(spark, root, ["a", "nope"])
    assert narrow.columns == ["a", "_malformed"] and narrow.where("_malformed is not null").count() == 2
    assert st.malformed_counts(narrow.withColumn("all", F.lit(1)), "all").first()["malformed"] == 2


def test_folder_edges(spark):
    root = tempfile.mkdtemp(prefix="taxomatch-mixed-")
    assert st.read_folder(spark, root + "/none", ["a"]).columns == ["a", "_malformed"]
    assert st.read_folder(spark, root, ["a"]).count() == 0
    _files(root + "/x", twice="a\ta\n1\t2\n")
    with pytest.raises(ValueError):
        st.read_folder(spark, root)
    _files(root + "/y", lines='a\tb\n"1\n1"\t2\n')
    df = st.read_folder(spark, root + "/y", multi_line=True)
    assert [tuple(r) for r in df.collect()] == [("1\n1", "2", None)]


def test_folder_of_compressed_files(spark):
    root = tempfile.mkdtemp(prefix="taxomatch-mixed-")
    rows = spark.createDataFrame([("1", "2")], "a string, b string")
    for k, cols in enumerate((["a", "b"], ["b", "a"])):
        rows.select(*cols).write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{root}/{k}")
    assert [tuple(r) for r in st.read_folder(spark, root, ["a", "b"]).collect()] == [("1", "2", None)] * 2


def _cached(spark, root):
    return sorted(r["code"] for r in read_vector_cache(spark, root, "m").collect())


def test_vector_cache_interrupted_write_is_never_seen(spark):
    from taxomatch.sources import vector_cache as vc

    root = tempfile.mkdtemp(prefix="taxomatch-vc-")
    rows = lambda *codes: spark.createDataFrame([(c, [1.0]) for c in codes], "code string, vec_task array<double>")
    vc.stage_vectors(rows("a"), root, "m")                      # ended before it published
    with pytest.raises(FileNotFoundError):
        read_vector_cache(spark, root, "m")
    write_vector_cache(rows("a", "b"), root, "m")               # nothing was published: not an overwrite
    with pytest.raises(Exception):                              # a writer whose job fails midway
        write_vector_cache(rows("x").withColumn("vec_task", F.raise_error(F.lit("lost")).cast("array<double>")), root, "m", overwrite=True)
    assert _cached(spark, root) == ["a", "b"]
    open(f"{root}/model=m/_manifests/00000002.json", "w").close()  # ended while it wrote its manifest
    assert _cached(spark, root) == ["a", "b"]
    before = read_vector_cache(spark, root, "m")
    write_vector_cache(rows("c"), root, "m", overwrite=True)
    assert _cached(spark, root) == ["c"] and before.count() == 2   # an earlier reader keeps its version
    assert vc.newest_version(spark, root, "m")[0] == 3
    assert vc.drop_old_versions(spark, root, "m") >= 2 and _cached(spark, root) == ["c"]


def test_vector_cache_of_two_writers_one_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    from taxomatch.sources import vector_cache as vc

    root = tempfile.mkdtemp(prefix="taxomatch-vc-")
    staged = [vc.stage_vectors(spark.createDataFrame([(c, [1.0])], "code string, vec_task array<double>"), root, "m") for c in "abcd"]

    def attempt(s):
        try:
            return vc.publish(spark, root, "m", s, 0)
        except vc.PublishedMeanwhile:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(attempt, staged))
    assert sorted(w for w in won if w) == [1]
    assert _cached(spark, root) == ["abcd"[won.index(1)]]
    assert vc.drop_old_versions(spark, root, "m") == 0             # the others deleted their rows
    r = read_vector_cache(spark, root, "m").first()
    assert (r["kb_rows"], r["model_name"], r["kb_path"]) == (1, "m", "")


def test_vector_cache_checks_its_rows(spark):
    root = tempfile.mkdtemp(prefix="taxomatch-vc-")
    folder = write_vector_cache(spark.createDataFrame([("a", [1.0])], "code string, vec_task array<double>"), root, "m")
    import glob

    spark.createDataFrame([("z", [2.0])], "code string, vec_task array<double>").write.mode("append").parquet(glob.glob(f"{folder}/data-*")[0])
    with pytest.raises(ValueError):
        read_vector_cache(spark, root, "m")
    assert read_vector_cache(spark, root, "m", check_rows=False).count() == 2
