"""Labelled data: cleaning, swapped-column repair, exact seeded splits,
training pairs and hard negatives.

Labelled rows use the internal names ``occupation``, ``description``,
``onet_soc``, ``onet_title`` (see ``harmonise``).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.functions.text import (QUERY_PREFIX, blank_to_empty, is_code, query_text,
                                      word_count)
from taxomatch.operators.prefix import running_sum, written

# Column names of the two survey workbooks and their internal
# names, and the keyword lists the app uses to guess title / description columns.
PRIMARY_NAMES = {"Job title": "occupation", "Job description": "description",
                 "O*NET_code": "onet_soc", "O*NET Job title": "onet_title"}
TITLE_ONLY_NAMES = {"occupation": "occupation", "onetJC": "onet_soc", "onetJT": "onet_title"}
TITLE_KEYWORDS = ("title", "occupation", "job", "role", "position")
DESC_KEYWORDS = ("description", "desc", "duties", "summary", "detail")


def harmonise(df: DataFrame, names: dict[str, str] = PRIMARY_NAMES) -> DataFrame:
    """Rename columns present in ``names``; absent names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def clean_labels(df: DataFrame, required=("occupation", "description", "onet_soc")) -> DataFrame:
    """Drop rows with an empty value in any required column (after strip)."""
    cond = None
    for c in required:
        ok = blank_to_empty(c) != F.lit("")
        cond = ok if cond is None else cond & ok
    return df.where(cond)


def swap_repair(df: DataFrame, code: str = "onet_soc", title: str = "onet_title",
                pre_filter: bool = False) -> DataFrame:
    """Where ``code`` is not a code, exchange ``code`` and ``title``; then drop
    rows whose code is still invalid. Training (``pre_filter=True``) drops
    blank codes before the swap; eval does not, so a blank code whose title
    column holds the code is rescued. Adds ``swapped`` (boolean)."""
    if pre_filter:
        df = df.where(blank_to_empty(code) != F.lit(""))
    bad = ~is_code(code)
    others = [c for c in df.columns if c not in (code, title)]
    fixed = df.select(*others,
                      F.when(bad, F.col(title)).otherwise(F.col(code)).alias(code),
                      F.when(bad, F.col(code)).otherwise(F.col(title)).alias(title),
                      bad.alias("swapped"))
    return fixed.where(is_code(code))


def min_words(df: DataFrame, column: str = "occupation", n: int = 2) -> DataFrame:
    """Keep rows whose text has at least ``n`` whitespace words."""
    return df.where(word_count(column) >= n)


def valid_codes(df: DataFrame, code: str = "onet_soc") -> DataFrame:
    return df.where(is_code(code))


def label_stats(df: DataFrame, code: str = "onet_soc") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(code).alias("codes"))


# ---------------------------------------------------------------------------
# Exact global order without a single-partition window
# ---------------------------------------------------------------------------

def ranked(df: DataFrame, order_cols: list[str], out: str = "rn", weight: str | None = None,
           rows_per_bucket: int = 1_000_000, n: int | None = None) -> DataFrame:
    """Exact running sum of ``weight`` (default 1, i.e. the 1-based row number)
    over the total order ``order_cols`` (the last column must make it unique).

    Rows are range-bucketed on the first order column (approximate quantiles;
    equal values share a bucket). Per-bucket totals give offsets (one number
    per bucket reaches the driver) and the running sum inside a bucket is a
    window partitioned by bucket, so no task holds more than one bucket.
    """
    first = order_cols[0]
    w_col = F.lit(1) if weight is None else F.col(weight)
    n = df.count() if n is None else n
    buckets = max(1, math.ceil(n / rows_per_bucket))
    if buckets == 1:
        # at most ``rows_per_bucket`` rows: one bounded window partition
        win = Window.partitionBy(F.lit(0)).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.sum(w_col).over(win).cast("long"))
    if buckets > 1:
        qs = df.where(F.col(first).isNotNull()).approxQuantile(first, [i / buckets for i in range(1, buckets)], 1.0 / (8 * buckets))
        splits = [-float("inf")] + sorted(set(float(q) for q in qs)) + [float("inf")]
        b = (Bucketizer(splits=splits, inputCol="_key_d", outputCol="_b")
             .transform(df.withColumn("_key_d", F.coalesce(F.col(first).cast("double"), F.lit(float("-inf"))))).drop("_key_d"))
    else:
        b = df.withColumn("_b", F.lit(0.0))
    totals = sorted((r["_b"], r["t"]) for r in b.groupBy("_b").agg(F.sum(w_col).alias("t")).collect())
    offsets, run = [], 0
    for bucket, t in totals:
        offsets.append((float(bucket), int(run)))
        run += t or 0
    off = df.sparkSession.createDataFrame(offsets, "_b double, _off long")
    win = Window.partitionBy("_b").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (b.join(F.broadcast(off), "_b")  # one row per bucket: n / rows_per_bucket rows
            .withColumn(out, F.col("_off") + F.sum(w_col).over(win))
            .drop("_b", "_off"))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average (fractional) rank of ``value`` with ties, 1-based, distributed:
    equal values are collapsed first, then ranked by running count."""
    d = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    n_values = d.count()
    r = ranked(d, [value], "_cum", weight="_c", n=n_values)
    r = r.select(value, (F.col("_cum") - (F.col("_c") - 1) / 2.0).alias(out))
    # one row per distinct value: a low-cardinality column (a 0/1 label holds
    # half the rows per value) must not become a hot shuffle key, so a rank
    # table of bounded size is broadcast; a large one is shuffle-joined
    if n_values <= 1_000_000:
        r = F.broadcast(r)
    return df.join(r, value, "left")


RANGES = 4096


def first_rows(df: DataFrame, order_key, tie: str, how_many) -> Column:
    """A condition on ``df`` that holds for exactly the first ``how_many(n)`` of
    its n rows in (``order_key``, ``tie``) order, nulls first.

    The value at the cut is found from counts per range of the key, then by
    sorting the one range that holds it; no row is ranked or moved, and the jobs
    read these two columns alone, so ``df`` should be written (``exact_split``
    and ``exact_sample`` do that). Rows with equal (key, tie) fall on one side
    together."""
    h = F.coalesce(order_key.cast("long"), F.lit(-(1 << 63)))
    rows = df.select(h.alias("_h"), F.col(tie).alias("_t"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi")).first()
    left = how_many(s["n"])
    if left <= 0 or left >= s["n"]:
        return F.lit(left > 0)
    width = (s["hi"] - s["lo"]) // RANGES + 1
    at = F.floor((F.col("_h").cast("decimal(20,0)") - F.lit(s["lo"])) / F.lit(width)).cast("int")
    for r in sorted(rows.groupBy(at.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()):  # at most RANGES + 1 rows
        if left <= r["n"]:
            inside = rows.where(at == r["r"]).orderBy("_h", F.col("_t").asc_nulls_first())
            last = inside.offset(left - 1).limit(1).first()
            break
        left -= r["n"]
    t = F.lit(last["_t"])
    return (h < last["_h"]) | ((h == last["_h"]) & (F.col(tie).isNull() | F.coalesce(F.col(tie) <= t, F.lit(False))))


def _with_hash(df: DataFrame, order_key) -> DataFrame:
    """``df`` written once with its order: whatever made it runs once, however
    often the cut and the result read it."""
    return written(df.withColumn("_h", F.coalesce(order_key.cast("long"), F.lit(-(1 << 63)))), "ordered-rows")


def exact_split(df: DataFrame, order_key, tie: str, train_frac: float = 0.8) -> DataFrame:
    """Shuffle by ``order_key`` (seeded hash), first ``int(n * train_frac)`` rows
    are 'train', the rest 'test'. Adds ``split``."""
    rows = _with_hash(df, order_key)
    first = first_rows(rows, F.col("_h"), tie, lambda n: int(n * train_frac))
    return rows.withColumn("split", F.when(first, "train").otherwise("test")).drop("_h")


def exact_sample(df: DataFrame, order_key, tie: str, frac: float = 0.2) -> DataFrame:
    """``round(frac * n)`` rows (Python rounding) with the smallest ``order_key``."""
    rows = _with_hash(df, order_key)
    return rows.where(first_rows(rows, F.col("_h"), tie, lambda n: round(frac * n))).drop("_h")


def shuffle_order(df: DataFrame, order_key, *tie: str) -> DataFrame:
    """``df`` with ``position``, from 0: the place of each row in the order of
    ``order_key`` (a seeded hash), ties by ``tie``. Numbered over range
    partitions; no task holds all rows."""
    return running_sum(df.withColumn("_order", order_key), [], ["_order", *tie], "position").drop("_order")


def shuffled(df: DataFrame, seed: int, *cols: str) -> DataFrame:
    """``df`` with ``shuffle_order``, a seeded hash of ``cols``: sorting by it
    gives the seeded order of the reference's shuffles without moving rows."""
    return df.withColumn("shuffle_order", F.xxhash64(F.lit(seed), *cols))


def removed_counts(df: DataFrame, test: DataFrame, keys=("occupation", "description")) -> DataFrame:
    """Rows that ``remove_keys`` keeps and removes, as a cleaning step: rows and
    test keys are counted per key, so a key of any weight is one row."""
    k = [blank_to_empty(c).alias(c) for c in keys]
    rows = df.select(*k).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = test.select(*k).distinct().withColumn("_known", F.lit(True))
    c = rows.join(known, list(keys), "left").agg(F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("a"),
                                                 F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("b"), F.lit(0).alias("_fixed"))
    return _steps(c, [("train_minus_test", "a", "b")])


def remove_keys(df: DataFrame, test: DataFrame, keys=("occupation", "description")) -> DataFrame:
    """Rows of ``df`` whose composite text key is not in ``test`` (anti-join;
    AQE splits a skewed key)."""
    t = test.select(*[blank_to_empty(k).alias(k) for k in keys]).distinct()
    d = df
    for k in keys:
        d = d.withColumn(f"_k_{k}", blank_to_empty(k))
    cond = [d[f"_k_{k}"] == t[k] for k in keys]
    return d.join(t, cond, "left_anti").drop(*[f"_k_{k}" for k in keys])


def union_tagged(frames: dict[str, DataFrame], tag: str = "Rater_Subset") -> DataFrame:
    """Union by name with ragged columns; each part tagged; missing string
    cells become '' (the reference leaks the text 'nan' here)."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    fills = {c: "" for c, t in out.dtypes if t == "string"}
    return out.na.fill(fills)


def guess_column(columns: list[str], keywords) -> str | None:
    """First column containing a keyword, keywords tried in order, case-
    insensitive substring; None when nothing matches."""
    for k in keywords:
        for c in columns:
            if k in c.lower():
                return c
    return None


def map_columns(df: DataFrame, title: str | None = None, description: str | None = None,
                keep=()) -> DataFrame:
    """Select ``(title, description)`` by name or by guessing. No title-like
    column falls back to the first column; no description-like column gives ''
    (the reference falls back to the first column there too)."""
    cols = df.columns
    t = title or guess_column(cols, TITLE_KEYWORDS) or cols[0]
    d = description or guess_column(cols, DESC_KEYWORDS)
    dcol = F.coalesce(F.col(d).cast("string"), F.lit("")) if d else F.lit("")
    return df.select(*keep, F.col(t).cast("string").alias("title"), dcol.alias("description"))


# ---------------------------------------------------------------------------
# Training pairs and hard negatives
# ---------------------------------------------------------------------------

def profile_map(kb: DataFrame, code: str = "code", profile: str = "profile", seq: str | None = None) -> DataFrame:
    """One profile per code; with duplicates the last (by ``seq``) wins."""
    k = kb.select(blank_to_empty(code).alias("code"), F.col(profile).alias("profile"),
                  (F.col(seq) if seq else F.lit(0)).alias("_seq"))
    return k.groupBy("code").agg(F.max_by("profile", "_seq").alias("profile"))


def train_pairs(rows: DataFrame, profiles: DataFrame, prefix: str = QUERY_PREFIX,
                row_id: str = "row_id") -> DataFrame:
    """``(anchor, positive)`` per labelled row whose code has a profile: anchor
    = prefix + stripped ``occupation description``; unknown codes are skipped
    (``pair_counts`` counts them)."""
    r = rows.select(row_id, blank_to_empty("onet_soc").alias("code"),
                    query_text("occupation", "description", prefix=prefix, strip=True).alias("anchor"))
    return r.join(profiles, "code", "inner").select(row_id, "anchor", F.col("profile").alias("positive"))


def _steps(counts: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """(step, kept, dropped, repaired) rows from one row of counts."""
    rows = [F.struct(F.lit(s).alias("step"), F.col(k).cast("long").alias("kept"), F.col(d).cast("long").alias("dropped"),
                     (F.col("_fixed") if s == "swap_repair" else F.lit(0)).cast("long").alias("repaired")) for s, k, d in steps]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def cleaning_counts(rows: DataFrame, code: str = "onet_soc", title: str = "onet_title") -> DataFrame:
    """What ``clean_labels`` and ``swap_repair(pre_filter=True)`` keep, drop and
    repair, counted in one pass: (step, kept, dropped, repaired)."""
    full = (blank_to_empty("occupation") != "") & (blank_to_empty("description") != "") & (blank_to_empty(code) != "")
    fixed = ~is_code(code) & is_code(title)
    ok = is_code(code) | fixed
    c = rows.agg(F.count_if(full).alias("_full"), F.count_if(~full).alias("_blank"), F.count_if(full & ok).alias("_ok"),
                 F.count_if(full & ~ok).alias("_bad"), F.count_if(full & fixed).alias("_fixed"))
    return _steps(c, [("clean_labels", "_full", "_blank"), ("swap_repair", "_ok", "_bad")])


def title_only_counts(rows: DataFrame, n: int = 2, code: str = "onet_soc") -> DataFrame:
    """The same for title-only rows: blanks, short titles, invalid codes."""
    full = (blank_to_empty("occupation") != "") & (blank_to_empty(code) != "")
    long = full & (word_count("occupation") >= n)
    c = rows.agg(F.count_if(full).alias("a"), F.count_if(~full).alias("b"), F.count_if(long).alias("c"), F.count_if(full & ~long).alias("d"),
                 F.count_if(long & is_code(code)).alias("e"), F.count_if(long & ~is_code(code)).alias("f"), F.lit(0).alias("_fixed"))
    return _steps(c, [("title_only_blank", "a", "b"), ("min_words", "c", "d"), ("valid_codes", "e", "f")])


def pair_counts(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Training rows whose code has a profile, and rows that ``train_pairs``
    skips."""
    known = profiles.select("code").distinct().withColumn("_known", F.lit(True))
    r = rows.select(blank_to_empty("onet_soc").alias("code")).join(known, "code", "left")
    c = r.agg(F.count_if(F.col("_known")).alias("a"), F.count_if(F.col("_known").isNull()).alias("b"), F.lit(0).alias("_fixed"))
    return _steps(c, [("train_pairs", "a", "b")])


def code_index(profiles: DataFrame) -> DataFrame:
    """Per KB code: its major group (first two characters), index inside the
    group (0-based, code order), group size, global index and KB size. Written
    once.

    Codes are numbered over range partitions, whatever the size of a group. Code
    order is (group, code) order, so a code's place in its group is its number
    less the group's first."""
    codes = profiles.select("code").distinct().withColumn("grp", F.left("code", F.lit(2)))
    numbered = written(running_sum(codes, [], ["code"], "aidx", total="asize"), "code-numbers")
    groups = numbered.groupBy("grp").agg(F.min("aidx").alias("_first"), F.count(F.lit(1)).alias("gsize"))
    out = numbered.join(groups, "grp").withColumn("gidx", F.col("aidx") - F.col("_first"))
    return written(out.select("code", "grp", "gidx", "gsize", "aidx", "asize"), "code-index")


def hard_negatives(rows: DataFrame, profiles: DataFrame, order_key, prefix: str = QUERY_PREFIX,
                   row_id: str = "row_id") -> DataFrame:
    """Evaluation pairs: per labelled row with a known code, a positive
    ``(anchor, profile, 1.0)`` and a negative ``(anchor, other profile, 0.0)``.
    The negative is a different code of the same major group (first two
    characters) or, when the group has no other code, any other code. The pick
    is uniform and seeded by ``order_key`` and is found by an equi-join on the
    picked index, so no row is paired with every code of its group."""
    idx = code_index(profiles)
    r = (rows.where(blank_to_empty("onet_soc") != F.lit(""))
         .select(row_id, blank_to_empty("onet_soc").alias("code"),
                 query_text("occupation", "description", prefix=prefix, strip=True).alias("anchor"),
                 order_key.alias("_h")))
    r = r.join(idx, "code", "inner")
    in_group = F.col("gsize") > 1
    j_g = F.pmod(F.col("_h"), F.col("gsize") - 1)
    j_a = F.pmod(F.col("_h"), F.greatest(F.col("asize") - 1, F.lit(1)))
    r = r.withColumn("_pick", F.when(in_group, j_g + F.when(j_g >= F.col("gidx"), 1).otherwise(0))
                     .otherwise(j_a + F.when(j_a >= F.col("aidx"), 1).otherwise(0)))
    by_g = idx.select(F.col("grp").alias("_g"), F.col("gidx").alias("_gi"), F.col("code").alias("neg_code"))
    by_a = idx.select(F.col("aidx").alias("_ai"), F.col("code").alias("neg_code2"))
    r = (r.join(by_g, (F.col("grp") == F.col("_g")) & (F.col("_pick") == F.col("_gi")) & in_group, "left")
         .join(by_a, (F.col("_pick") == F.col("_ai")) & ~in_group & (F.col("asize") > 1), "left")
         .withColumn("neg_code", F.coalesce("neg_code", "neg_code2")))
    pos = r.join(profiles, "code").select(row_id, "anchor", F.col("profile").alias("s2"), F.lit(1.0).alias("score"),
                                          F.col("code").alias("s2_code"))
    neg = (r.where(F.col("neg_code").isNotNull())
           .join(profiles.withColumnRenamed("code", "neg_code"), "neg_code")
           .select(row_id, "anchor", F.col("profile").alias("s2"), F.lit(0.0).alias("score"),
                   F.col("neg_code").alias("s2_code")))
    return pos.unionByName(neg).withColumnRenamed("anchor", "s1")
