"""Knowledge-base build: flatten, nest, task weights, star join, title join.

Source tables are keyed by an occupation ``code``. Input order matters for
the flattened text and the nested task list, so each source carries an
explicit order column ``seq`` (for files: a source order column, or
``monotonically_increasing_id()`` straight after the scan).

All group-bys here are keyed by ``code``; partial aggregation runs map-side.
A group's output row is, by definition, the whole group (one text or one list
per code); nothing is capped or dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.functions.text import importance_weight, normalized_key


def flatten_text(df: DataFrame, key: str, text: str, out: str, seq: str = "seq",
                 sep: str = " | ") -> DataFrame:
    """Non-null texts of each key joined by ``sep`` in ``seq`` order. A key with
    only null texts gets ''; rows with a null key are dropped."""
    return (df.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(),
                                                    F.struct(F.col(seq).alias("s"), F.col(text).cast("string").alias("t"))))).alias("_l"))
            .select(key, F.array_join(F.transform("_l", lambda x: x["t"]), sep).alias(out)))


def task_weights(tasks: DataFrame, ratings: DataFrame | None, key: str = "code",
                 task_id: str = "task_id", scale: str = "scale_id", rating: str = "rating",
                 scale_value: str = "IM") -> DataFrame:
    """Tasks left-joined to their importance rating on (code, task id), rating
    mapped to a weight. Only ratings on the ``IM`` scale are used; with no
    ratings table every weight is the default 0.5."""
    if ratings is None:
        joined = tasks.withColumn("rating", F.lit(None).cast("string"))
    else:
        r = (ratings.where(F.col(scale) == F.lit(scale_value))
             .select(key, task_id, F.col(rating).cast("string").alias("rating")))
        joined = tasks.join(r, [key, task_id], "left")
    return joined.withColumn("weight", importance_weight("rating"))


def nest_tasks(weighted: DataFrame, key: str = "code", task: str = "task", weight: str = "weight",
               seq: str = "seq", as_json: bool = False) -> DataFrame:
    """Per code, the list of ``{task, weight}`` in input order: natively
    ``array<struct<task,weight>>``; ``as_json`` gives the JSON text. The task
    text of a null task becomes ''."""
    items = (weighted.groupBy(key)
             .agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"),
                                                       F.coalesce(F.col(task).cast("string"), F.lit("")).alias("task"),
                                                       F.col(weight).cast("double").alias("weight")))).alias("_l"))
             .select(key, F.transform("_l", lambda x: F.struct(x["task"].alias("task"), x["weight"].alias("weight"))).alias("tasks")))
    if as_json:
        items = items.select(key, F.to_json("tasks").alias("structured_tasks"))
    return items


def build_kb(occupations: DataFrame, tasks: DataFrame | None, alt_titles: DataFrame | None,
             tech_skills: DataFrame | None, tools: DataFrame | None, key: str = "code") -> DataFrame:
    """Star join: occupations left-joined to nested tasks and the three
    flattened lists on ``code``; text nulls become ''. Every side is one row
    per code, so there is no fan-out; the sides share the ``code`` hash
    partitioning from their group-bys."""
    kb = occupations
    for side in (tasks, alt_titles, tech_skills, tools):
        if side is not None:
            kb = kb.join(side, key, "left")
    fills = {c: "" for c, t in kb.dtypes if t == "string"}
    kb = kb.na.fill(fills)
    if "tasks" in kb.columns:
        kb = kb.withColumn("tasks", F.coalesce("tasks", F.array().cast("array<struct<task:string,weight:double>>")))
    return kb


def replace_values(df: DataFrame, column: str, mapping: dict[str, str], out: str | None = None) -> DataFrame:
    """Exact whole-value replacement from a literal map; other values unchanged."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or column, F.coalesce(F.element_at(m, F.col(column)), F.col(column)))


def title_code_join(survey: DataFrame, taxonomy: DataFrame, survey_title: str, taxonomy_title: str,
                    code: str, fixes: dict[str, str] | None = None, fanout: bool = True) -> DataFrame:
    """Attach codes to survey rows by a normalised title (stripped, lower-case)
    left join. Titles are first corrected by ``fixes``; the helper columns are
    dropped.

    ``fanout=True`` keeps the reference's behaviour: a title that appears
    several times in the taxonomy yields one output row per code. With
    ``fanout=False`` the taxonomy is first grouped by title (taxonomy-sized),
    so every survey row stays one row, with ``code`` = the lowest code and
    ``codes`` = all of them; no (row, code) pairs are emitted for a repeated
    title."""
    s = survey
    if fixes:
        s = replace_values(s, survey_title, fixes, out="_fixed")
    else:
        s = s.withColumn("_fixed", F.col(survey_title))
    s = s.withColumn("_match_title", normalized_key("_fixed"))
    t = taxonomy.select(F.col(code), normalized_key(taxonomy_title).alias("_match_title"))
    if not fanout:
        t = (t.groupBy("_match_title").agg(F.array_sort(F.collect_set(code)).alias("codes"))
             .withColumn(code, F.element_at("codes", 1)))
    return s.join(t, "_match_title", "left").drop("_match_title", "_fixed")


def unmatched_counts(joined: DataFrame, code: str, title: str) -> DataFrame:
    """Matched and unmatched row counts. As in the reference, 'matched' counts
    every row that is not (null code and non-null title)."""
    unmatched = F.col(code).isNull() & F.col(title).isNotNull()
    return joined.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_if(~unmatched).alias("matched"),
                      F.count_if(unmatched).alias("unmatched"))
