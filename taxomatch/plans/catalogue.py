"""Query catalogue: one function per operator key, (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through ``standins``) and runs whole
tables and whole texts. Floats are rounded (6 dp, percentages as the
reference shows them) so the SQL oracle can compare values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.functions import text as tx
from taxomatch.functions.vectors import APP_WEIGHTS, ENGINE_WEIGHTS, FIELDS, TUNED_WEIGHTS, cosine, norm
from taxomatch.operators import evaluate as ev
from taxomatch.operators import kb as kbo
from taxomatch.operators import labels as lb
from taxomatch.operators import lexical as lx
from taxomatch.operators import report as rp
from taxomatch.operators.centroid import weighted_centroid
from taxomatch.operators.encode import BatchEncoder, HashingEncoder, encode_chunked, kb_vectors, pooled_table_model
from taxomatch.operators.match import MatchConfig, match, match_one, prepare_kb, to_long, to_wide
from taxomatch.operators.simjoin import SimilarityJoin
from taxomatch.plans import standins as si
from taxomatch.session import bounded_broadcast, reliable_checkpoint, scratch_dir
from taxomatch.sources import tables as st
from taxomatch.sources.vector_cache import read_vector_cache, write_vector_cache

R = 6  # decimals for floats compared with the oracle


def rnd(c, n: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

def scan_prune(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "part_tsv")
    st.write_delimited(si.table(spark, d, "part"), path, sep="\t")
    return st.read_delimited(spark, path, ["p_partkey", "p_name", "no_such_column"], sep="\t")


def _mixed_folder(spark, d) -> DataFrame:
    """Customers in three folders of delimited files: other columns in another
    order in each, and rows that lack or exceed cells in two of them."""
    root = scratch_dir(spark, "mixed_tsv")
    c = si.table(spark, d, "customer")
    c = c.withColumn("key", F.col("c_custkey").cast("string")).withColumn("nation", F.col("c_nationkey").cast("string"))
    k = F.col("c_custkey")
    layouts = {"a": ["key", "c_name", "c_mktsegment"], "b": ["c_mktsegment", "nation", "key"], "c": ["c_name", "key"]}
    for place, (name, cols) in enumerate(layouts.items()):
        row = F.concat_ws("\t", *cols)
        if name != "b":
            row = F.when(k % 11 == 0, F.concat(row, F.lit("\textra\tcells"))).when(k % 7 == 0, F.col(cols[0])).otherwise(row)
        # one text column, headed by the names: the lines stand as they are
        lines = c.where(k % 3 == place).select(row.alias("\t".join(cols)))
        st.write_delimited(lines, f"{root}/{name}", sep="\u0001")
    df = st.read_folder(spark, root, ["key", "c_name", "c_mktsegment", "no_such_column", "nation"], file="file")
    return df.withColumn("folder", F.regexp_extract("file", "([^/]+)/[^/]+$", 1)).drop("file")


def mixed_sources(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_folder(spark, d).withColumnRenamed("_malformed", "malformed")


def mixed_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.malformed_counts(_mixed_folder(spark, d), "folder")


def scan_fill(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "documents_tsv")
    st.write_delimited(si.table(spark, d, "documents").select("doc_id", "text", "lang", "source"), path, sep="\t")
    df = st.fill_blank(st.read_delimited(spark, path, None, sep="\t", multi_line=True))  # texts hold line feeds
    return df.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), F.length("text").alias("text_len"))


def roundtrip_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "conversations_csv")
    st.write_delimited(si.table(spark, d, "conversations"), path, sep=",")
    df = st.read_delimited(spark, path, None, sep=",", multi_line=True)  # texts hold line feeds
    return df.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def strip_all(spark: SparkSession, d: str) -> DataFrame:
    df = st.strip_all(si.table(spark, d, "conversations"))
    return df.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), F.length("text").alias("text_len"))


def preview_limit(spark: SparkSession, d: str) -> DataFrame:
    return st.preview(si.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 3)


def weights_merge(spark: SparkSession, d: str) -> DataFrame:
    """A weights file computed from ``embeddings`` (four known fields and one
    unknown), written as csv, read back and merged with the defaults."""
    e = si.embeddings(spark, d).select(F.posexplode("v").alias("pos", "x"))
    names = F.element_at(F.array(*[F.lit(n) for n in ("Tasks", "Description", "Skills", "Ofc_Title", "Bogus")]),
                         (F.col("pos") % 6 + 1).cast("int"))
    rows = (e.where(F.col("pos") % 6 < 5).groupBy(names.alias("field"))
            .agg(F.avg(F.abs("x")).alias("weight")))
    path = scratch_dir(spark, "weights_csv")
    st.write_delimited(rows.coalesce(1), path, sep=",")
    w = st.read_weights(spark, path, TUNED_WEIGHTS)
    return w.select("field", rnd("weight", 9).alias("weight"))


def vector_cache(spark: SparkSession, d: str) -> DataFrame:
    kb = si.vector_kb(spark, d).select("code", *[f"vec_{f}" for f in FIELDS])
    root = scratch_dir(spark, "vectors")
    write_vector_cache(kb, root, "models/demo encoder")
    back = read_vector_cache(spark, root, "models/demo encoder")
    return back.select("code", "kb_rows", *[rnd(norm(f"vec_{f}"), 9).alias(f"norm_{f}") for f in FIELDS])


# ---------------------------------------------------------------------------
# Projections, renames, unions, title join
# ---------------------------------------------------------------------------

def harmonise(spark: SparkSession, d: str) -> DataFrame:
    return lb.harmonise(si.survey_raw(spark, d))


def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    s = si.table(spark, d, "supplier").withColumnsRenamed(
        {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "acctbal"})
    c = si.table(spark, d, "customer").withColumnsRenamed(
        {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "acctbal", "c_mktsegment": "segment"})
    return lb.union_tagged({"Matched": s, "Non-Matched": c})


SEGMENT_TITLE_FIXES = {" Nation_3": " Nation_13", " Nation_24": "Atlantis"}  # stand-in rename map


def _survey_titles(spark, d):
    c = si.table(spark, d, "customer")
    title = F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(" Nation_"), F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", title.alias("final_title"))


def taxonomy_fix(spark: SparkSession, d: str) -> DataFrame:
    return kbo.replace_values(_survey_titles(spark, d), "final_title", SEGMENT_TITLE_FIXES, out="fixed_title")


def title_code_join(spark: SparkSession, d: str) -> DataFrame:
    tax = si.table(spark, d, "nation")
    j = kbo.title_code_join(_survey_titles(spark, d), tax, "final_title", "n_name", "n_nationkey",
                            fixes=SEGMENT_TITLE_FIXES)
    return j.select("c_custkey", "final_title", F.col("n_nationkey").alias("code"))


def unmatched_report(spark: SparkSession, d: str) -> DataFrame:
    return kbo.unmatched_counts(title_code_join(spark, d), "code", "final_title")


def map_columns(spark: SparkSession, d: str) -> DataFrame:
    return lb.map_columns(si.table(spark, d, "conversations"), keep=("conv_id", "turn"))


# ---------------------------------------------------------------------------
# Labelled data
# ---------------------------------------------------------------------------

def _labels(spark, d):
    return st.strip_all(lb.harmonise(si.survey_raw(spark, d)))


def clean_labels(spark: SparkSession, d: str) -> DataFrame:
    return lb.clean_labels(_labels(spark, d)).select("row_id", "occupation", "description", "onet_soc")


def _train_rows(spark, d):
    return lb.swap_repair(lb.clean_labels(_labels(spark, d)), pre_filter=True)


def swap_repair(spark: SparkSession, d: str) -> DataFrame:
    return _train_rows(spark, d).select("row_id", "onet_soc", "onet_title", F.col("swapped").cast("int").alias("swapped"))


def swap_repair_eval(spark: SparkSession, d: str) -> DataFrame:
    return lb.swap_repair(_labels(spark, d), pre_filter=False).select(
        "row_id", "onet_soc", "onet_title", F.col("swapped").cast("int").alias("swapped"))


def _title_only(spark, d):
    t = st.strip_all(lb.harmonise(si.title_only_raw(spark, d), lb.TITLE_ONLY_NAMES)).withColumn("description", F.lit(""))
    t = t.where((tx.blank_to_empty("occupation") != "") & (tx.blank_to_empty("onet_soc") != ""))
    return lb.valid_codes(lb.min_words(t, "occupation", 2))


def min_words(spark: SparkSession, d: str) -> DataFrame:
    return _title_only(spark, d).select("row_id", "occupation", "onet_soc")


def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return lb.label_stats(_train_rows(spark, d))


def _split(spark, d):
    t = _train_rows(spark, d)
    return lb.exact_split(t, si.ahash("row_id"), "row_id", 0.8)


def split_exact(spark: SparkSession, d: str) -> DataFrame:
    """The split written as Parquet (the held-out sink) and read back."""
    path = scratch_dir(spark, "split")
    _split(spark, d).select("row_id", "split").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sample_exact(spark: SparkSession, d: str) -> DataFrame:
    train = _split(spark, d).where(F.col("split") == "train")
    return lb.exact_sample(train, si.ahash(F.col("row_id") + 7), "row_id", 0.2).select("row_id")


def train_minus_test(spark: SparkSession, d: str) -> DataFrame:
    test = _split(spark, d).where(F.col("split") == "test")
    raters = _labels(spark, d)
    kept = lb.remove_keys(raters, test, ("occupation", "description"))
    return kept.where(tx.blank_to_empty("onet_soc") != "").select("row_id")


def _train_union(spark, d):
    train = _split(spark, d).where(F.col("split") == "train").select(
        F.lit("primary").alias("source"), "row_id", "occupation", "description", "onet_soc")
    title_only = _title_only(spark, d).select(
        F.lit("title_only").alias("source"), "row_id", "occupation", "description", "onet_soc")
    return train.unionByName(title_only)


def train_union(spark: SparkSession, d: str) -> DataFrame:
    return _train_union(spark, d).select("source", "row_id", "occupation", "onet_soc")


# ---------------------------------------------------------------------------
# Knowledge base
# ---------------------------------------------------------------------------

def _weighted_tasks(spark, d):
    """A task's id is its order and line number; joining on the two numbers
    spares a second join with orders and the text ids."""
    return kbo.task_weights(si.task_rows(spark, d), si.rating_rows(spark, d), key="l_orderkey", task_id="l_linenumber")


def task_weight(spark: SparkSession, d: str) -> DataFrame:
    w = _weighted_tasks(spark, d)
    return w.select("code", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("task_id"),
                    "task", "rating", F.col("weight"))


def _tasks_text(c):
    return F.array_join(F.transform(c, lambda t: F.concat(t["task"], F.lit(":"), F.format_string("%.2f", t["weight"]))), ";")


def task_nest(spark: SparkSession, d: str) -> DataFrame:
    n = kbo.nest_tasks(_weighted_tasks(spark, d))
    return n.select("code", F.size("tasks").alias("n_tasks"), _tasks_text("tasks").alias("tasks_text"))


def flatten_text(spark: SparkSession, d: str) -> DataFrame:
    return kbo.flatten_text(si.alt_title_rows(spark, d), "code", "text", "all_alt_titles")


def _kb(spark, d):
    return kbo.build_kb(
        si.occupations(spark, d),
        kbo.nest_tasks(_weighted_tasks(spark, d)),
        kbo.flatten_text(si.alt_title_rows(spark, d), "code", "text", "all_alt_titles"),
        kbo.flatten_text(si.skill_rows(spark, d), "code", "text", "all_tech_skills"),
        kbo.flatten_text(si.tool_rows(spark, d), "code", "text", "all_tools"))


def kb_build(spark: SparkSession, d: str) -> DataFrame:
    k = _kb(spark, d)
    return k.select("code", "title", "description", _tasks_text("tasks").alias("tasks_text"),
                    "all_alt_titles", "all_tech_skills", "all_tools")


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = si.table(spark, d, "events")
    p = F.from_json("props", "k long")
    return e.select("event_id", p["k"].alias("k"), F.to_json(F.struct(p["k"].alias("k"))).alias("props_out"))


def _profiles(spark, d):
    k = (si.occupations(spark, d)
         .join(kbo.flatten_text(si.alt_title_rows(spark, d), "code", "text", "all_alt_titles"), "code", "left")
         .join(kbo.flatten_text(si.skill_rows(spark, d), "code", "text", "all_tech_skills"), "code", "left"))
    k = k.na.fill({"all_alt_titles": "", "all_tech_skills": ""})
    prof = k.select("code", "seq", tx.profile_text("title", "description", "all_alt_titles", "all_tech_skills").alias("profile"))
    return lb.profile_map(prof, seq="seq")


def profile_text(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d)


def query_text(spark: SparkSession, d: str) -> DataFrame:
    lab = lb.harmonise(si.survey_raw(spark, d))
    return lab.select("row_id",
                      tx.query_text("occupation", "description").alias("text_plain"),
                      tx.query_text("occupation", "description", prefix=tx.QUERY_PREFIX, strip=True).alias("text_app"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    doc = si.table(spark, d, "documents")
    t = tx.tokens(F.coalesce("text", F.lit("")))
    return doc.select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"),
                      F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def title_words(spark: SparkSession, d: str) -> DataFrame:
    p = si.table(spark, d, "part")
    w = tx.title_words(F.concat_ws(" ", "p_name", "p_type", F.lit("Workers of all Supervisors")))
    return p.select("p_partkey", F.array_join(F.array_sort(w), " ").alias("words"))


def train_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _train_union(spark, d).withColumn("pair_key", F.concat_ws(":", "source", F.col("row_id").cast("string")))
    p = lb.train_pairs(rows, _profiles(spark, d), row_id="pair_key")
    return p.select("pair_key", "anchor", "positive")


def shuffle_order(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of both sources in their seeded order."""
    rows = _train_union(spark, d).select("source", "row_id", "onet_soc")
    return lb.shuffle_order(rows, si.ahash(F.col("row_id") + 42), "source", "row_id")


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    test = _split(spark, d).where(F.col("split") == "test")
    pairs = lb.hard_negatives(test, _profiles(spark, d), si.ahash("row_id"))
    return pairs.select("row_id", "s1", "s2_code", "score", F.md5("s2").alias("s2_md5"))


# ---------------------------------------------------------------------------
# Vectors and matching
# ---------------------------------------------------------------------------

def weighted_centroid_q(spark: SparkSession, d: str) -> DataFrame:
    e = si.embeddings(spark, d)
    c = weighted_centroid(e, "label", "v", si.centroid_weight(), "cw")
    return c.select("label", F.posexplode("cw").alias("pos", "value")).select("label", "pos", rnd("value", 9).alias("value"))


def chunk_mean(spark: SparkSession, d: str) -> DataFrame:
    e = si.embeddings(spark, d)
    c = weighted_centroid(e, "label", "v", None, "m")
    return c.select("label", F.posexplode("m").alias("pos", "value")).select("label", "pos", rnd("value", 9).alias("value"))


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    doc = si.table(spark, d, "documents")
    # chunks are computed once per row; the sizes are read from the result
    ch = doc.select("doc_id", tx.chunk_text("text", 800, hyphens=True).alias("chunks"))
    lens = F.transform("chunks", lambda c: F.length(c))
    return ch.select("doc_id", F.size("chunks").alias("n_chunks"),
                     F.aggregate(lens, F.lit(0), lambda a, x: a + x).cast("long").alias("total_len"),
                     F.coalesce(F.array_max(lens), F.lit(0)).cast("long").alias("max_len"),
                     F.md5(F.array_join("chunks", "\n")).alias("chunks_md5"))


def cosine_fields(spark: SparkSession, d: str) -> DataFrame:
    q = si.vector_queries(spark, d).select("query_id", "vec", "label")
    kb = bounded_broadcast(si.vector_kb(spark, d).select("label", *[f"vec_{f}" for f in FIELDS]))
    j = q.join(kb, "label")
    return j.select(F.col("query_id").alias("vec_id"),
                    *[rnd(cosine("vec", f"vec_{f}")).alias(f"cos_{f}") for f in FIELDS])


def _match(spark, d, cfg: MatchConfig, words: str = "eval", keep=()):
    """Only the columns the output needs go through the Python worker
    (Catalyst cannot prune through ``mapInPandas``)."""
    q = si.vector_queries(spark, d, words)
    kb = si.vector_kb(spark, d, words)
    cols = ["query_id", "vec", *(["title_words"] if cfg.title_boost else []), *keep]
    return match(q.select(*cols), kb, cfg)


def match_topk(spark: SparkSession, d: str) -> DataFrame:
    r = _match(spark, d, MatchConfig(weights=ENGINE_WEIGHTS))
    return to_wide(r.select("query_id", "codes", "titles", "scores", "raw_scores"), "production").withColumnRenamed("query_id", "vec_id")


def match_topk_blocked(spark: SparkSession, d: str) -> DataFrame:
    r = _match(spark, d, MatchConfig(weights=ENGINE_WEIGHTS, force_blocked=True, kb_block_rows=4))
    return to_wide(r.select("query_id", "codes", "titles", "scores", "raw_scores"), "production").withColumnRenamed("query_id", "vec_id")


def similarity_join(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding that is no query is a KB row: its six masked fields, each
    of length 1, weighted and summed; a fifth of the embeddings are queries."""
    e = si.embeddings(spark, d)
    kb = prepare_kb(si.field_kb(e.where("vec_id % 5 <> 0")), MatchConfig(weights=ENGINE_WEIGHTS))
    found = SimilarityJoin(kb, vec="vec_fused", block_rows=256).topk(e.where("vec_id % 5 = 0").select("vec_id", F.col("v").alias("vec")), 3)
    return found.select("vec_id", "rank", "code", rnd("score").alias("score"))


def match_topk_boosted(spark: SparkSession, d: str) -> DataFrame:
    r = _match(spark, d, MatchConfig(weights=TUNED_WEIGHTS, title_boost=tx.TITLE_BOOST))
    w = to_wide(r.select("query_id", "codes", "titles", "scores", "raw_scores"), "eval")
    return w.select(F.col("query_id").alias("vec_id"), "Machine_SOC_Code", "Machine_Title", "Machine_Confidence",
                    F.array_join("Top_Codes", "|").alias("Top_Codes"))


def _app_result(spark, d):
    r = _match(spark, d, MatchConfig(weights=TUNED_WEIGHTS, title_boost=tx.TITLE_BOOST), words="app")
    return to_wide(r.select("query_id", "codes", "titles", "scores", "raw_scores"), "app").withColumnRenamed("query_id", "vec_id")


def match_topk_app(spark: SparkSession, d: str) -> DataFrame:
    return _app_result(spark, d)


def _eval_rows(spark, d):
    r = _match(spark, d, MatchConfig(weights=TUNED_WEIGHTS, title_boost=tx.TITLE_BOOST),
               keep=("occupation", "description", "onet_soc", "onet_title"))
    return ev.eval_rows(r)


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return _eval_rows(spark, d).withColumnRenamed("query_id", "vec_id")


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    s = ev.eval_summary(_eval_rows(spark, d))
    return s.select("n", "top1", "top3", rnd("top1_pct").alias("top1_pct"), rnd("top3_pct").alias("top3_pct"),
                    "top3_gap", rnd("avg_conf").alias("avg_conf"), rnd("conf_gap").alias("conf_gap"), "no_code")


def pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    q = si.vector_queries(spark, d).where(F.col("onet_soc") != "").withColumnRenamed("query_id", "row_id")
    kb = si.vector_kb(spark, d)
    prof = kb.select("code", F.col("title").alias("profile"))
    pairs = lb.hard_negatives(q, prof, si.ahash("row_id"), prefix="")
    vecs = bounded_broadcast(kb.select(F.col("code").alias("s2_code"), "c"))
    p = (pairs.join(q.select("row_id", "vec"), "row_id").join(vecs, "s2_code")
         .select(F.round(cosine("vec", "c"), 9).alias("cosine"), "score"))
    c = ev.pair_correlation(p)
    return c.select(rnd("cosine_pearson", 9).alias("cosine_pearson"), rnd("cosine_spearman", 9).alias("cosine_spearman"), "pairs")


WEIGHT_CANDIDATES = (
    (0.25, 0.20, 0.15, 0.25, 0.10, 0.05),
    tuple(ENGINE_WEIGHTS[n] for n in ("Tasks", "Description", "Skills", "Ofc_Title", "Alt_Titles", "Tools")),
    tuple(APP_WEIGHTS[n] for n in ("Tasks", "Description", "Skills", "Ofc_Title", "Alt_Titles", "Tools")),
    (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 1, 0, 0),
    (0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 1), (1, 1, 1, 1, 1, 1), (-2, 1, 0, 3, 0.5, 0),
)


def _truth_queries(spark, d):
    q = si.vector_queries(spark, d)
    return q.select("query_id", "vec", si.label_code(F.col("label")).alias("truth_code"))


def weight_accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = ev.weight_accuracy(_truth_queries(spark, d), si.vector_kb(spark, d), WEIGHT_CANDIDATES)
    return a.select("candidate", "hits", "rows", rnd("accuracy", 9).alias("accuracy"))


def weight_search(spark: SparkSession, d: str) -> DataFrame:
    """Field weights found on a fifth of the labelled rows that are not test
    rows, written as ``field,weight`` and read back as a matcher reads them."""
    rows = lb.exact_split(_truth_queries(spark, d), si.ahash("query_id"), "query_id", 0.8).where("split = 'train'")
    sample = lb.exact_sample(rows, si.ahash(F.col("query_id") + 7), "query_id", 0.2)
    found = ev.weight_search(sample, si.vector_kb(spark, d))
    path = scratch_dir(spark, "found_weights")
    st.write_delimited(found.select("field", "weight").coalesce(1), path, sep=",")
    back = st.read_weights(spark, path, TUNED_WEIGHTS)
    return (back.join(F.broadcast(found.drop("weight")), "field")  # six rows
            .select("field", rnd("weight", 9).alias("weight"), rnd("accuracy", 9).alias("accuracy"), rnd("baseline_accuracy", 9).alias("baseline_accuracy")))


# ---------------------------------------------------------------------------
# Lexical
# ---------------------------------------------------------------------------

def _bench_corpus(spark, d):
    b = si.table(spark, d, "benchmark")
    return b.select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("code"),
                    F.col("item_id").cast("string").alias("title"), "text")


def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    post = lx.bm25_postings(_bench_corpus(spark, d), "code", "text")
    return post.select(F.col("code").cast("long").alias("item_id"), "token", "tf",
                       rnd("idf", 9).alias("idf"), rnd("weight", 9).alias("weight"))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = si.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"),
                                                   tx.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    r = lx.bm25_topk(docs, _bench_corpus(spark, d), 3)
    return r.select(F.col("query_id").alias("doc_id"), "rank", F.col("code").cast("long").alias("item_id"), rnd("score").alias("score"))


def title_overlap(spark: SparkSession, d: str) -> DataFrame:
    corpus = _bench_corpus(spark, d).withColumn("title_words", tx.title_words("text"))
    docs = si.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"),
                                                   tx.title_words("text").alias("title_words"))
    r = lx.overlap_topk(docs, corpus, 3)
    return r.select(F.col("query_id").alias("doc_id"), "rank", F.col("code").cast("long").alias("item_id"), "overlap")


# ---------------------------------------------------------------------------
# Reports over app-format results
# ---------------------------------------------------------------------------

def major_group(spark: SparkSession, d: str) -> DataFrame:
    r = rp.with_tiers(_app_result(spark, d))
    return r.select("vec_id", "Matched_SOC_Code", "Major_Group", "Tier", "Colour")


def confidence_tier(spark: SparkSession, d: str) -> DataFrame:
    t = rp.tier_counts(_app_result(spark, d))
    return t.select("rows", "high", "moderate", "low", rnd("avg_conf").alias("avg_conf"))


def top_occupations(spark: SparkSession, d: str) -> DataFrame:
    return rp.top_occupations(_app_result(spark, d))


def group_confidence(spark: SparkSession, d: str) -> DataFrame:
    g = rp.group_confidence(_app_result(spark, d))
    return g.select("Major_Group", rnd("Avg_Conf").alias("Avg_Conf"), "Count")


def conf_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = rp.histogram(_app_result(spark, d), "Confidence_%", 20)
    return h.select("bin", rnd("lo").alias("lo"), rnd("hi").alias("hi"), rnd("mid").alias("mid"), "count")


def report(spark: SparkSession, d: str) -> DataFrame:
    """All parts of the batch report from one pass over the matches."""
    r = rp.report(_app_result(spark, d))
    return r.select("section", "item", "n", rnd("value").alias("value"))


def cleaning_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept, dropped and repaired by each cleaning step."""
    rows = _labels(spark, d)
    steps = lb.cleaning_counts(rows)
    title_only = st.strip_all(lb.harmonise(si.title_only_raw(spark, d), lb.TITLE_ONLY_NAMES)).withColumn("description", F.lit(""))
    known = _profiles(spark, d).select("code")
    test = _split(spark, d).where(F.col("split") == "test")
    return (steps.unionByName(lb.title_only_counts(title_only)).unionByName(lb.removed_counts(rows, test))
            .unionByName(lb.pair_counts(_train_union(spark, d), known)))


# ---------------------------------------------------------------------------
# Sources that a user may bring
# ---------------------------------------------------------------------------

def user_input(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "users_csv")
    s = si.table(spark, d, "supplier")
    users = s.select(F.col("s_suppkey").alias("User_ID"), F.concat(F.lit(" "), "s_name").alias("User_Job_Title"),
                     F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("sells, \"for\" "), F.col("s_nationkey").cast("string"))).alias("User_Job_Description"))
    st.write_delimited(users, path)
    return st.read_user_input(spark, path)


def sheet_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two sheets of one workbook, of different formats, read by name."""
    book = scratch_dir(spark, "book")
    st.write_delimited(si.table(spark, d, "nation").select("n_nationkey", "n_name"), f"{book}/Matched.csv")
    si.table(spark, d, "region").select("r_regionkey", "r_name").write.parquet(f"{book}/Non-Matched.parquet")
    a = st.read_sheet(spark, book, "Matched").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = st.read_sheet(spark, book, "Non-Matched", ["r_regionkey", "r_name"]).select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    return lb.union_tagged({"Matched": a, "Non-Matched": b}, "sheet")


def file_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """One table written in four formats and read back by suffix."""
    root = scratch_dir(spark, "formats")
    c = si.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment")
    st.write_delimited(c, f"{root}/t.csv")
    st.write_delimited(c, f"{root}/t.tsv", sep="\t")
    c.write.json(f"{root}/t.jsonl")
    c.write.parquet(f"{root}/t.parquet")
    return lb.union_tagged({e: st.read_table(spark, f"{root}/t.{e}", ["c_custkey", "c_mktsegment"]) for e in ("csv", "tsv", "jsonl", "parquet")}, "format")


# ---------------------------------------------------------------------------
# Encoders and the three matchers end to end on text
# ---------------------------------------------------------------------------
DIM = 384


def _elements(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Non-zero vector elements (outer: the vectors are not made twice, once for
    a size filter of the optimizer)."""
    return df.select(key, F.posexplode_outer(vec).alias("pos", "value")).where("value <> 0").select(key, "pos", rnd("value").alias("value"))


def encode_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = si.table(spark, d, "documents")
    enc = HashingEncoder(dim=DIM).fit(docs, "text")
    return _elements(enc(docs.select("doc_id", "text"), "text", "vec"), "doc_id", "vec")


def encode_batch(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts through a batch model in worker processes."""
    docs = si.table(spark, d, "documents")
    v = BatchEncoder(pooled_table_model(16), 16)(docs.select("doc_id", "text"), "text", "vec")
    return v.select("doc_id", F.posexplode_outer("vec").alias("pos", "value")).select("doc_id", "pos", rnd("value", 9).alias("value"))


def blank_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk means of documents, a seventh of them blank (zero vectors)."""
    docs = si.table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).when(F.col("doc_id") % 7 == 1, F.lit(None)).otherwise(F.col("text"))
    enc = HashingEncoder(dim=DIM).fit(docs, "text")
    v = encode_chunked(docs.select("doc_id", text.alias("text")), "doc_id", "text", enc, "vec")
    return v.select("doc_id", F.size("vec").alias("dims"), rnd(norm("vec")).alias("norm"))


def _tax_kb(spark, d, orders: DataFrame) -> DataFrame:
    """The taxonomy: 125 rows at any size."""
    tasks = si.tax_tasks(orders)
    weighted = kbo.task_weights(tasks.drop("rating", "scale_id"), tasks.select("code", "task_id", "scale_id", "rating"))
    return kbo.build_kb(si.tax_occupations(spark, d), kbo.nest_tasks(weighted),
                        kbo.flatten_text(si.tax_alt_titles(orders), "code", "text", "all_alt_titles"),
                        kbo.flatten_text(si.tax_skills(orders), "code", "text", "all_tech_skills"), None)


def _tax_vectors(spark, d, mode: str, orders: DataFrame):
    """(knowledge base with vectors, encoder). The text rows are written once:
    the fit, the six fields and the BM25 corpus read them."""
    kb = reliable_checkpoint(_tax_kb(spark, d, orders))
    corpus = kb.select(F.concat_ws(" ", "title", "description", "all_alt_titles", "all_tech_skills").alias("text"))
    enc = HashingEncoder(dim=DIM).fit(corpus, "text")
    return kb_vectors(kb, enc, mode=mode), enc


def _kb_elements(v: DataFrame) -> DataFrame:
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"vec_{f}").alias("vec")) for f in FIELDS]))
    flat = v.select("code", long.alias("x")).select("code", "x.field", F.posexplode_outer("x.vec").alias("pos", "value"))
    return flat.where("value <> 0").select("code", "field", "pos", rnd("value").alias("value"))


def kb_vectors_q(spark: SparkSession, d: str) -> DataFrame:
    return _kb_elements(_tax_vectors(spark, d, "whole", si.tax_orders(spark, d))[0])


def kb_vectors_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Six-field encode: tasks weighted by importance, other fields chunk-meaned."""
    return _kb_elements(_tax_vectors(spark, d, "chunk", si.tax_orders(spark, d))[0])


def text_match_production(spark: SparkSession, d: str) -> DataFrame:
    """Production: chunked vectors, plain query text, dense score alone."""
    orders = si.tax_orders(spark, d)
    kbv, enc = _tax_vectors(spark, d, "chunk", orders)
    rows = si.tax_survey(orders).withColumn("text", tx.query_text("occupation", "description"))
    q = enc(rows.select("query_id", "text"), "text", "vec", sparse=True).drop("text")
    return to_wide(match(q, kbv, MatchConfig(weights=ENGINE_WEIGHTS)), "production")


def _rater_rows(orders: DataFrame) -> DataFrame:
    """The raters' two tables as one, stripped; the second lacks the titles. A
    reference number in the text tells rows apart, as free text does."""
    rows = si.tax_survey(orders)
    rows = rows.withColumn("description", F.concat_ws(" ", "description", F.concat(F.lit("ref "), F.col("query_id").cast("string"))))
    second = F.col("query_id") % 3 == 0
    return st.strip_all(lb.union_tagged({"Matched": rows.where(~second), "Non-Matched": rows.where(second).drop("onet_title")}))


def weight_search_text(spark: SparkSession, d: str) -> DataFrame:
    """Line search of the field weights from the baseline on the raters' rows:
    the union less the rows of the test split and those without a code, a fifth
    of the rest, encoded and matched to the taxonomy."""
    orders = si.tax_orders(spark, d)
    kbv, enc = _tax_vectors(spark, d, "chunk", orders)
    raters = _rater_rows(orders)
    coded = raters.where("Rater_Subset = 'Matched' AND onet_soc <> ''")
    test = lb.exact_split(coded, si.ahash("query_id"), "query_id", 0.8).where("split = 'test'")
    rows = lb.remove_keys(raters, test).where("onet_soc <> ''")
    sample = lb.exact_sample(rows, si.ahash(F.col("query_id") + 7), "query_id", 0.2)
    q = enc(sample.select(tx.query_text("occupation", "description").alias("text"), F.col("onet_soc").alias("truth_code")), "text", "vec", sparse=True)
    found = ev.weight_search(q, kbv, candidates=0)
    return found.select("field", rnd("weight", 9).alias("weight"), rnd("accuracy", 9).alias("accuracy"), rnd("baseline_accuracy", 9).alias("baseline_accuracy"))


def _hybrid(spark, d) -> DataFrame:
    orders = si.tax_orders(spark, d)
    kbv, enc = _tax_vectors(spark, d, "chunk", orders)
    corpus = kbv.select("code", lx.corpus_text("title", "all_alt_titles", "description").alias("text"))
    kbv = kbv.withColumn("title_words", tx.title_words("title")).join(lx.bm25_index(corpus, "code", "text"), "code", "left")
    rows = si.tax_survey(orders).withColumn("text", tx.query_text("occupation", "description"))
    q = enc(rows, "text", "vec", sparse=True).withColumn("tokens", tx.tokens("text")).withColumn("title_words", tx.title_words("occupation")).drop("text")
    return match(q, kbv, MatchConfig(weights=TUNED_WEIGHTS, title_boost=tx.TITLE_BOOST, bm25_weight=0.2))


def text_match_eval(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation: chunked vectors, plain query text, dense + BM25 + title boost."""
    r = ev.eval_rows(_hybrid(spark, d))
    return r.select("query_id", "Machine_SOC_Code", "Machine_Title", "Machine_Confidence", "Human_SOC_Code", "Correct", "Correct_Top3")


def text_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    s = ev.eval_summary(ev.eval_rows(_hybrid(spark, d)))
    return s.select("n", "top1", "top3", rnd("top1_pct").alias("top1_pct"), rnd("top3_pct").alias("top3_pct"), "top3_gap",
                    rnd("avg_conf").alias("avg_conf"), rnd("conf_gap").alias("conf_gap"), "no_code")


def text_match_app(spark: SparkSession, d: str) -> DataFrame:
    """App: whole-text vectors (the task slot is the title), prefixed and
    stripped query text, title boost on raw words."""
    orders = si.tax_orders(spark, d)
    kbv, enc = _tax_vectors(spark, d, "whole", orders)
    kbv = kbv.withColumn("title_words", tx.title_words("title", (), None))
    rows = si.tax_survey(orders).withColumn("text", tx.query_text("occupation", "description", prefix=tx.QUERY_PREFIX, strip=True))
    q = enc(rows.select("query_id", "occupation", "text"), "text", "vec", sparse=True).withColumn("title_words", tx.title_words("occupation", (), None))
    r = match(q.drop("occupation", "text"), kbv, MatchConfig(weights=TUNED_WEIGHTS, title_boost=tx.TITLE_BOOST))
    return to_wide(r, "app")


def single_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One typed-in title and description against the whole taxonomy."""
    kbv, enc = _tax_vectors(spark, d, "chunk", si.tax_orders(spark, d))
    r = match_one(spark, kbv, "Furniture buyer", "orders of nation_7 by customers", lambda df: enc(df, "text", "vec"), MatchConfig(weights=ENGINE_WEIGHTS, k=10))
    return to_long(r).select("rank", "code", "title", rnd("score").alias("score"))


QUERIES = {
    "scan_prune": scan_prune, "scan_fill": scan_fill, "roundtrip_csv": roundtrip_csv, "strip_all": strip_all,
    "mixed_sources": mixed_sources, "mixed_counts": mixed_counts, "preview_limit": preview_limit, "weights_merge": weights_merge, "vector_cache": vector_cache,
    "harmonise": harmonise, "union_tagged": union_tagged, "taxonomy_fix": taxonomy_fix,
    "title_code_join": title_code_join, "unmatched_report": unmatched_report, "map_columns": map_columns,
    "clean_labels": clean_labels, "swap_repair": swap_repair, "swap_repair_eval": swap_repair_eval,
    "min_words": min_words, "label_stats": label_stats, "split_exact": split_exact, "sample_exact": sample_exact,
    "train_minus_test": train_minus_test, "train_union": train_union,
    "task_weight": task_weight, "task_nest": task_nest, "flatten_text": flatten_text, "kb_build": kb_build,
    "json_roundtrip": json_roundtrip, "profile_text": profile_text, "query_text": query_text, "tokens": tokens,
    "title_words": title_words, "train_pairs": train_pairs, "hard_negatives": hard_negatives, "shuffle_order": shuffle_order,
    "weighted_centroid": weighted_centroid_q, "chunk_mean": chunk_mean, "chunk_text": chunk_text,
    "cosine_fields": cosine_fields, "match_topk": match_topk, "match_topk_blocked": match_topk_blocked, "similarity_join": similarity_join,
    "match_topk_boosted": match_topk_boosted, "match_topk_app": match_topk_app,
    "eval_rows": eval_rows, "eval_summary": eval_summary, "pair_correlation": pair_correlation,
    "weight_accuracy": weight_accuracy, "weight_search": weight_search,
    "bm25_index": bm25_index, "bm25_scores": bm25_scores, "title_overlap": title_overlap,
    "major_group": major_group, "confidence_tier": confidence_tier, "top_occupations": top_occupations,
    "group_confidence": group_confidence, "conf_histogram": conf_histogram,
    "encode_hash": encode_hash, "encode_batch": encode_batch, "kb_vectors": kb_vectors_q, "kb_vectors_chunked": kb_vectors_chunked,
    "text_match_production": text_match_production, "text_match_eval": text_match_eval, "text_eval_summary": text_eval_summary,
    "text_match_app": text_match_app, "weight_search_text": weight_search_text, "single_lookup": single_lookup, "blank_chunks": blank_chunks,
    "report": report, "cleaning_report": cleaning_report, "user_input": user_input, "sheet_scan": sheet_scan, "file_dispatch": file_dispatch,
}
