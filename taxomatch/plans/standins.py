"""Stand-in inputs derived by Spark from the driver tables.

The reference's own inputs (taxonomy text files, survey workbooks, model
weights) are not available, so each input role is played by a table Spark
derives from the driver tables; all of them grow with the data:

* vector KB: per-label centroids of ``embeddings`` (the taxonomy is the label
  set, bounded); queries: every ``embeddings`` row.
* text KB: one occupation per ``customer``; tasks from ``lineitem``; alternate
  titles / skills from ``orders``; tools from ``nation``.
* taxonomy: one occupation per market segment and nation (125 at any size),
  with tasks, alternate titles and skills from the orders of its customers.
* labelled survey rows: one per ``orders`` row, with blanks, padding and
  swapped code/title columns built in.
* title-only rows: one per ``supplier`` row.

The arithmetic hash ``(x * 1103515245 + 12345) mod 2147483647`` orders rows
where the SQL oracle must repeat the order (xxhash64 is Spark-only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.functions.text import title_words
from taxomatch.functions.vectors import mask_positions
from taxomatch.operators.centroid import centroids
from taxomatch.operators.prefix import written
from taxomatch.session import spread_input

# Stand-in vocabulary for the ten embedding labels (fixed values of this repo).
LABEL_WORDS = ("Nurse", "Teacher", "Driver", "Clerk", "Engineer", "Analyst", "Cook", "Guard", "Painter", "Welder")
HASH_A, HASH_B, HASH_P = 1103515245, 12345, 2147483647


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d.rstrip('/')}/{name}.parquet"
    return spread_input(spark.read.parquet(path), path)


def ahash(c) -> F.Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.pmod(x.cast("long") * F.lit(HASH_A) + F.lit(HASH_B), F.lit(HASH_P))


def soc_code(major_src, minor_src) -> F.Column:
    """``dd-dddd.00`` from two integers."""
    return F.format_string("%02d-%04d.00", major_src.cast("int"), minor_src.cast("int"))


def _word(i) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in LABEL_WORDS]), (i % 10 + 1).cast("int"))


# ---------------------------------------------------------------------------
# Vector KB and queries from ``embeddings``
# ---------------------------------------------------------------------------

def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def label_code(label) -> F.Column:
    return soc_code(F.lit(11) + F.lit(2) * label, F.lit(1000) + label)


def label_title(label) -> F.Column:
    return F.concat(_word(label), F.lit(" and "), _word(label + 1), F.lit(" Workers"))


def centroid_weight() -> F.Column:
    return ((F.col("vec_id") % 5) + 1) / F.lit(5.0)


def vector_kb(spark, d, words: str = "eval") -> DataFrame:
    """Ten KB rows: task field = weighted centroid, other fields = mean
    centroid, field f keeping positions with index mod 6 == f."""
    e = embeddings(spark, d)
    kb = centroids(e, "label", "v", {"c": None, "cw": centroid_weight()})
    title = label_title(F.col("label"))
    kb = kb.select(
        "label", label_code(F.col("label")).alias("code"), title.alias("title"),
        mask_positions("cw", 0, 6).alias("vec_task"), mask_positions("c", 1, 6).alias("vec_desc"),
        mask_positions("c", 2, 6).alias("vec_skill"), mask_positions("c", 3, 6).alias("vec_ofc_title"),
        mask_positions("c", 4, 6).alias("vec_alt_title"), mask_positions("c", 5, 6).alias("vec_tool"),
        "c")
    tw = title_words("title") if words == "eval" else title_words("title", (), None)
    return kb.withColumn("title_words", tw)


def field_kb(e: DataFrame) -> DataFrame:
    """One KB row per embedding: field f keeps the positions with index mod 6 == f."""
    names = ("task", "desc", "skill", "ofc_title", "alt_title", "tool")
    code = F.lpad(F.col("vec_id").cast("string"), 12, "0")
    return e.select(code.alias("code"), code.alias("title"), *[mask_positions("v", k, 6).alias(f"vec_{f}") for k, f in enumerate(names)])


def vector_queries(spark, d, words: str = "eval") -> DataFrame:
    e = embeddings(spark, d)
    title = F.concat(_word(F.col("label") + F.col("vec_id") % 3), F.lit(" Supervisors"))
    q = e.select(F.col("vec_id").alias("query_id"), "label", title.alias("occupation"),
                 F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("description"),
                 F.when(F.col("vec_id") % 13 == 0, F.lit("")).otherwise(label_code(F.col("label"))).alias("onet_soc"),
                 label_title(F.col("label")).alias("onet_title"),
                 F.col("v").alias("vec"))
    tw = title_words("occupation") if words == "eval" else title_words("occupation", (), None)
    return q.withColumn("title_words", tw)


# ---------------------------------------------------------------------------
# Text KB sources from the TPC-H-like tables
# ---------------------------------------------------------------------------

CODES = 230_000  # combinations of the two numbers of a code; beyond them a code gets a suffix


def cust_code(c) -> F.Column:
    """A code per customer: no two customers share one."""
    x = F.col(c)
    plain = soc_code(F.lit(11) + F.lit(2) * F.pmod(x, F.lit(23)), F.pmod(x, F.lit(10000)))
    return F.when(x < CODES, plain).otherwise(F.concat(plain, F.lit("-"), F.floor(x / CODES).cast("string")))


def occupations(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(cust_code("c_custkey").alias("code"), F.col("c_name").alias("title"),
                    F.concat(F.col("c_mktsegment"), F.lit(" buyer from nation "), F.col("c_nationkey").cast("string")).alias("description"),
                    F.col("c_custkey").alias("seq"))


def task_rows(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    t = li.join(o, li.l_orderkey == o.o_orderkey)
    return t.select(cust_code("o_custkey").alias("code"), "l_orderkey", "l_linenumber",
                    F.concat(F.lit("ship part "), F.col("l_partkey").cast("string"), F.lit(" qty "),
                             F.col("l_quantity").cast("int").cast("string")).alias("task"),
                    (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"))


def rating_rows(spark, d) -> DataFrame:
    """Ratings by (order, line), the two numbers that make up a task's id."""
    li = table(spark, d, "lineitem")
    g = (li.groupBy("l_orderkey", "l_linenumber")
         .agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("flag")))
    rating = (F.when(F.col("q") > 45, F.lit(None).cast("string"))
              .when(F.col("q") > 40, F.lit(""))
              .when(F.col("l_linenumber") == 7, F.lit("n/a"))
              .otherwise((F.lit(1.0) + F.col("q") * F.lit(0.08)).cast("string")))
    return g.select("l_orderkey", "l_linenumber", F.when(F.col("flag") == "R", F.lit("LV")).otherwise(F.lit("IM")).alias("scale_id"),
                    rating.alias("rating"))


def alt_title_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(cust_code("o_custkey").alias("code"), F.col("o_orderpriority").alias("text"),
                    F.col("o_orderkey").alias("seq"))


def skill_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(cust_code("o_custkey").alias("code"),
                    F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("text"),
                    F.col("o_orderkey").alias("seq"))


def tool_rows(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 rows at any size
            .select(cust_code("c_custkey").alias("code"), F.col("n_name").alias("text"),
                    F.col("c_custkey").alias("seq")))


# ---------------------------------------------------------------------------
# Labelled rows
# ---------------------------------------------------------------------------

def survey_raw(spark, d) -> DataFrame:
    """Survey rows with the reference's column names (before ``harmonise``)."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pr = F.regexp_replace("o_orderpriority", r"^[0-9]-", "")
    occupation = (F.when(k % 11 == 0, F.lit(""))
                  .when(k % 5 == 0, F.concat(F.lit(" "), pr, F.lit(" manager ")))
                  .otherwise(pr))
    desc = F.when(k % 13 == 0, F.lit("")).otherwise(
        F.concat(F.lit("order "), k.cast("string"), F.lit(" status "), F.col("o_orderstatus")))
    code = cust_code("o_custkey")
    title = F.concat(F.lit("Title "), F.col("o_custkey").cast("string"))
    soc = (F.when(k % 17 == 0, F.lit("")).when(k % 4 == 0, title).when(k % 19 == 0, F.lit("x")).otherwise(code))
    soc_title = (F.when(k % 17 == 0, code).when(k % 4 == 0, code).when(k % 19 == 0, F.lit("y")).otherwise(title))
    return o.select(k.alias("row_id"), occupation.alias("Job title"), desc.alias("Job description"),
                    soc.alias("O*NET_code"), soc_title.alias("O*NET Job title"))


def title_only_raw(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    occ = F.when(k % 3 == 0, F.lit("Clerk")).otherwise(F.concat(F.lit("Supply clerk "), (k % 7).cast("string")))
    return s.select(k.alias("row_id"), occ.alias("occupation"), cust_code("s_suppkey").alias("onetJC"),
                    F.concat(F.lit("Title "), k.cast("string")).alias("onetJT"))


# ---------------------------------------------------------------------------
# A taxonomy of bounded size, and survey rows to match to it
# ---------------------------------------------------------------------------
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _tax_customers(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))  # 25 rows at any size
    place = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
    code = soc_code(F.lit(11) + F.lit(2) * F.pmod(F.col("c_nationkey"), F.lit(23)), F.col("c_nationkey") * 100 + place)
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", F.lower("c_mktsegment").alias("segment"), code.alias("code"))


def _tax_orders(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    c = _tax_customers(spark, d)
    return o.join(c, o.o_custkey == c.c_custkey)


def tax_orders(spark, d) -> DataFrame:
    """The orders with their customers' occupations, joined and written once:
    a query's tasks, titles, skills and survey rows all read them."""
    cols = ("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "n_name", "segment", "code")
    return written(_tax_orders(spark, d).select(*cols), "tax-orders")


def tax_occupations(spark, d) -> DataFrame:
    c = _tax_customers(spark, d).groupBy("code", "segment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    return c.select("code", F.concat(F.initcap("segment"), F.lit(" Buyers of "), F.col("n_name")).alias("title"),
                    F.concat(F.lit("Buys "), F.col("segment"), F.lit(" goods for customers in "), F.lower("n_name")).alias("description"))


def tax_tasks(orders: DataFrame) -> DataFrame:
    """One task per code and order priority, rated by the share of finished orders."""
    g = orders.groupBy("code", "o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    task = F.concat(F.lit("handle "), F.lower("o_orderpriority"), F.lit(" orders"))
    return g.select("code", F.col("o_orderpriority").alias("task_id"), task.alias("task"), F.lit("IM").alias("scale_id"),
                    F.concat(F.lit(""), F.round(1 + 4 * F.col("share"), 2).cast("string")).alias("rating"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("seq"))


def tax_alt_titles(orders: DataFrame) -> DataFrame:
    """One alternate title per code and year of its orders."""
    g = orders.select("code", "segment", F.year("o_orderdate").alias("y")).distinct()
    return g.select("code", F.concat(F.col("segment"), F.lit(" procurement specialist "), F.col("y").cast("string")).alias("text"), F.col("y").alias("seq"))


def tax_skills(orders: DataFrame) -> DataFrame:
    """One skill per code, order status and priority: long lists make several chunks."""
    g = orders.select("code", "segment", "n_name", "o_orderstatus", "o_orderpriority").distinct()
    text = F.concat(F.lit("tracks "), F.col("segment"), F.lit(" orders of status "), F.col("o_orderstatus"), F.lit(" and priority "),
                    F.col("o_orderpriority"), F.lit(" for "), F.col("n_name"))
    return g.select("code", text.alias("text"), F.concat("o_orderstatus", "o_orderpriority").alias("seq"))


def tax_survey(orders: DataFrame) -> DataFrame:
    """One survey row per order, with the code of its customer's occupation."""
    title = F.when(F.col("o_orderkey") % 7 == 0, F.lit("Specialist")).otherwise(F.concat(F.lit("  "), F.initcap("segment"), F.lit(" buyer ")))
    desc = F.concat(F.lit("I handle "), F.lower("o_orderpriority"), F.lit(" orders of "), F.lower("n_name"), F.lit(" in status "), F.col("o_orderstatus"))
    return orders.select(F.col("o_orderkey").alias("query_id"), title.alias("occupation"), F.when(F.col("o_orderkey") % 9 != 0, desc).alias("description"),
                    F.when(F.col("o_orderkey") % 13 == 0, F.lit("")).otherwise(F.col("code")).alias("onet_soc"), F.lit("").alias("onet_title"))
