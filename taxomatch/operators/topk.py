"""Exact top-k of sparse scores by postings and upper bounds (MaxScore), in the JVM.

score(query, item) = sum over shared tokens of (count in the query) x (weight in
the item). A query whose tokens stand in at most ``FULL_ROWS`` postings meets them
all, and its scores are their sums by item: a sum costs far less than a pair
that is scored by itself. For the others tokens have one global order: highest
weight anywhere first, then the rarest. In that order

* each query first meets the items of its first few tokens; their exact scores
  give a lower bound of its k-th best score;
* a query's last tokens, whose upper bounds (count x highest weight) sum to less
  than that bound, are not joined: an item that shares only those cannot be
  among the best. Likewise for an item's last tokens;
* what is left is joined on the token, each pair once, and scored exactly inside
  its row from the two token arrays.

Queries are dealt by key over a number of tasks that grows with the postings they
meet, so a task's share, and its memory, does not grow with the input.

Places that no positive score fills go to items of score 0, lowest code first,
then to negative ones. Only queries with open places look for them, among the
lowest codes; if weights are negative, such a query meets all its tokens' items.

Scores that are equal to 12 decimals, relative to the query's highest, are ties
and go to the lower code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.operators.prefix import running_sum
from taxomatch.session import scratch_dir

SEED_TOKENS = 6  # tokens that give the first bound; any number gives the same result
SLACK = 1e-9  # far above the rounding of a sum
DECIMALS = 12
BROADCAST_BYTES = 64 << 20
FULL_ROWS = 100_000  # postings that a query meets without bounds; any number gives the same result
TASK_ROWS = 4_000_000  # postings met by the queries of one task


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, tasks: int = 0) -> DataFrame:
    """Rows by query over as many tasks as a shuffle has, or ``tasks`` if that is
    more: what follows is heavy for its bytes, so they are not merged again."""
    spark = df.sparkSession
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


class Postings:
    """The items' side, written once. ``vocabulary``: a number per token in the
    global order and its highest weight; ``items``: a number per code, in code
    order, with its tokens' numbers in order and their weights; ``flat``: a row
    per token of an item, with what its tokens from this one on add at most."""

    def __init__(self, postings: DataFrame, codes: DataFrame, repeats: bool = True):
        self.repeats, self.tasks, self.work = repeats, 0, 0
        postings = _written(postings.select("code", "token", F.col("weight").cast("double").alias("weight")), "topk-postings")
        vocab = postings.groupBy("token").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("df"))
        vocab = vocab.orderBy(F.desc("top"), "df", "token").withColumn("tid", F.monotonically_increasing_id())
        vocab = _written(vocab, "topk-vocabulary")
        items = _written(running_sum(codes.select("code").distinct(), [], ["code"], "item"), "topk-items")
        flat = postings.join(vocab.select("token", "tid"), "token").join(items, "code").select("item", "tid", "weight")
        later = Window.partitionBy("item").orderBy(F.desc("tid"))
        flat = _written(flat.withColumn("item_rest", F.sum(F.greatest("weight", F.lit(0.0))).over(later)), "topk-flat")
        terms = flat.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("tid", "weight"))).alias("t"))
        size, low, high = flat.agg(F.count(F.lit(1)), F.min("weight"), F.max("weight")).first()
        chars = vocab.agg(F.sum(F.octet_length("token") + 40)).first()[0] or 0
        names = items.agg(F.sum(F.octet_length("code") + 40)).first()[0] or 0
        # a hint only behind the size of what has been written; beyond it Spark shuffles
        self.small = size * 40 + chars + names <= BROADCAST_BYTES
        hint = F.broadcast if self.small else lambda df: df
        self.negative, self.unit = (low or 0.0) < 0, low == high == 1.0 and not repeats
        self.vocabulary, self.items, self.flat = hint(vocab.select("token", "tid", "top", "df")), hint(items), hint(flat)
        self.held = hint(_written(terms.select("item", F.col("t.tid").alias("item_ids"), F.col("t.weight").alias("weights")), "topk-held"))

    def queries(self, tokens: DataFrame, key: str) -> DataFrame:
        """Per query its known tokens in order: numbers, counts, and the sum of
        the upper bounds from each on; ``work``: the postings they stand in."""
        bound = F.greatest(F.col("top"), F.lit(0.0)) * F.col("count")
        later = Window.partitionBy(key).orderBy(F.desc("tid"))
        known = dealt(tokens.select(key, "token").join(self.vocabulary, "token").select(key, "tid", "top", "df"), key)
        counted = known.groupBy(key, "tid", "top", "df").agg((F.count(F.lit(1)) if self.repeats else F.lit(1).cast("long")).alias("count"))
        q = counted.withColumn("rest", F.sum(bound).over(later))
        q = q.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tid", "count", "rest"))).alias("t"), F.max("count").alias("most"), F.sum("df").alias("work"))
        more = F.expr("filter(t, x -> x.count > 1)")  # few lists are looked through for counts
        q = q.select(key, F.col("t.tid").alias("ids"), F.col("t.rest").alias("rests"), F.col("t.count").alias("counts"), "most", "work", more.alias("more"))
        q = _written(q.select(key, "ids", "rests", "counts", "most", "work", F.col("more.tid").alias("more_ids"), F.col("more.count").alias("more_counts")), "topk-queries")
        total, self.work = q.agg(F.sum("work"), F.max("work")).first()
        self.tasks, self.work = (total or 0) // TASK_ROWS + 1, self.work or 0
        return q

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        return dealt(df, key, self.tasks)

    def met(self, tokens: DataFrame, key: str) -> DataFrame:
        """Tokens of dealt queries with the items that hold them: still dealt by
        query, which a broadcast does not change."""
        met = tokens.join(self.flat, "tid")
        return met if self.small else self.dealt(met, key)

    def summed(self, q: DataFrame, key: str) -> DataFrame:
        """(key, item, score) of every item that shares a token with a query."""
        each = self.dealt(q.select(key, "ids", "counts"), key).select(key, F.explode(F.arrays_zip("ids", "counts")).alias("x"))
        each = each.select(key, F.col("x.ids").alias("tid"), F.col("x.counts").alias("count"))
        return self.met(each, key).groupBy(key, "item").agg(F.sum(F.col("count") * F.col("weight")).alias("score"))

    def scored(self, pairs: DataFrame, q: DataFrame, key: str) -> DataFrame:
        """(key, item, score): summed over the shared numbers of the two arrays."""
        pairs = self.dealt(pairs, key).distinct().join(self.dealt(q.select(key, "ids", "more_ids", "more_counts"), key), key).join(self.held, "item")
        if self.unit:
            return pairs.select(key, "item", F.size(F.array_intersect("ids", "item_ids")).cast("double").alias("score"))
        weight = "weights[cast(array_position(item_ids, t) - 1 as int)]"
        once = F.expr(f"aggregate(array_intersect(ids, item_ids), 0D, (s, t) -> s + {weight})")
        more = F.expr(f"aggregate(array_intersect(more_ids, item_ids), 0D, (s, t) -> s + (more_counts[cast(array_position(more_ids, t) - 1 as int)] - 1) * {weight})")
        return pairs.select(key, "item", (once + more).alias("score"))


def _best(scored: DataFrame, p: Postings, k: int, key: str) -> DataFrame:
    """The ``k`` best rows of each query with their rank, ties to the lower
    item, and ``relative``: the score by the query's highest if that is positive."""
    top = F.max("score").over(Window.partitionBy(key))
    scored = p.dealt(scored, key).withColumn("_top", top).withColumn("relative", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(F.col("score")))
    order = Window.partitionBy(key).orderBy(F.desc(F.round("relative", DECIMALS)), "item")
    return scored.drop("_top").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_topk(tokens: DataFrame, postings: DataFrame, codes: DataFrame, k: int = 3, key: str = "query_id", fill: DataFrame | None = None,
                repeats: bool = True, seed_tokens: int = SEED_TOKENS, full_rows: int = FULL_ROWS) -> DataFrame:
    """(key, rank, code, score, relative) of the ``k`` best items of each query.

    ``tokens``: (key, token), a row per token of a query, keys not null; without
    ``repeats`` a token counts once however often it comes;
    ``postings``: (code, token, weight), one row per code and token; ``codes``:
    every item's code; ``fill``: the keys whose open places are filled with other
    items (None: only positive scores are listed)."""
    p = Postings(postings, codes, repeats)
    q = p.queries(tokens, key)
    met = p.summed(q.where(F.col("work") <= full_rows), key)
    if p.work > full_rows:
        met = met.unionByName(_bounded(p, q.where(F.col("work") > full_rows), k, key, seed_tokens))
    best = _best(met, p, k, key).where("score > 0")
    if fill is not None:
        best = _filled(_written(best, "topk-best"), p, q, fill.select(key).distinct(), k, key)
    return best.join(p.items, "item").select(key, "rank", "code", "score", "relative")


def _bounded(p: Postings, q: DataFrame, k: int, key: str, seed_tokens: int) -> DataFrame:
    """(key, item, score) of the items that can be among the ``k`` best."""
    each = q.select(key, F.posexplode(F.arrays_zip("ids", "rests")).alias("pos", "x"), "most").select(key, "pos", F.col("x.ids").alias("tid"), F.col("x.rests").alias("rest"), "most")
    first = each.where(F.col("pos") < seed_tokens).join(p.flat, "tid").select(key, "item")
    first = _written(p.scored(first, q, key), "topk-first")
    order = Window.partitionBy(key).orderBy(F.desc("score"))
    kth = p.dealt(first.where("score > 0"), key).withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(key, (F.col("score") - SLACK).alias("bound"))
    later = each.where(F.col("pos") >= seed_tokens).join(kth, key, "left")
    later = later.withColumn("bound", F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(SLACK))).where(F.col("rest") >= F.col("bound"))
    met = later.join(p.flat, "tid").where(F.col("item_rest") * F.col("most") >= F.col("bound")).select(key, "item")
    met = p.dealt(met, key).distinct().join(p.dealt(first.select(key, "item"), key), [key, "item"], "left_anti")
    return first.unionByName(p.scored(met, q, key))


def _filled(best: DataFrame, p: Postings, q: DataFrame, keys: DataFrame, k: int, key: str) -> DataFrame:
    """Open places go to the lowest items of score 0, then to negative ones: a
    query looks at as many lowest items as it has places and met items, for no
    more than those can be taken."""
    full = best.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    open_ = keys.join(full.where(F.col("n") >= k), key, "left_anti")
    if p.negative:
        near = q.join(open_, key, "left_semi")
        met = p.summed(near, key)
    else:
        met = best.select(key, "item", "score").join(open_, key, "left_semi")
    met = _written(met, "topk-met")
    need = open_.join(met.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, (F.coalesce("n", F.lit(0)) + k).alias("need"))
    zeros = need.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)).alias("item")).join(p.items.select("item"), "item")
    zeros = zeros.join(met.select(key, "item"), [key, "item"], "left_anti").select(key, "item", F.lit(0.0).alias("score"))
    return best.join(open_, key, "left_anti").unionByName(_best(met.unionByName(zeros), p, k, key))
