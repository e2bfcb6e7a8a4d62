"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, its documents one after the other in the order of their
keys, are packed into blocks of ``block`` words; the last one may be shorter.
The mix is a number of output shards of ``shard`` slots; a slot takes one block.

Targets: sources by code point, null last, weigh 1, 2, 3 and so on in turn and
share the words of all sources; a source above ``most`` times its words stops
there, and what it leaves is shared by weight among the others until none is
above.

Draws: each slot of a shard draws its source with the sources' shares of all
slots, so a shard's source counts are multinomial. Prefix sums of the counts
over shards number a source's slots. The few slots drawn beyond a source's own
number go, in order, to the sources that were drawn too seldom, so every source
ends with its number of slots. A slot's number is a place in the source's stream
of epochs; in each epoch a pseudorandom permutation of the source's full blocks
(swap or not: a bijection of any range, no table of it is kept) gives the block,
and the short block comes last. The last slot of a source takes only the words
that its target still lacks. Blocks then meet the documents by (source, block).

So a source's words taken are its target rounded down, and no word is taken
more often than the epochs begun, at most ``most`` times.

All draws are arithmetic on slot and source numbers, so reruns agree. Hot
sources: documents are numbered by range partitions, blocks and slots are the
unit of every join, and no join key grows with a source.

Defined results: null and empty texts have size 0 and nothing taken; a null
source is a source of its own, as is an empty one; a source without words has
target 0; null keys come first in a source's order; rows of equal key and size
may change places, each has a result; without any word all targets are 0; an
empty table gives an empty result; texts of any length are counted whole and a
long one takes many blocks; other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.llm.common import saved
from taxomatch.operators.prefix import running_sum

WORD = r"[^\x20\x09-\x0D]+"
PRIME = 2147483647
#: Multipliers of the permutation's rounds.
ROUNDS = [48271 + 2 * 7919 * k * k for k in range(1, 13)]
CELLS = 1_000_000  # cells that a line of numbers is cut into, at most
SMALL = 64 << 20  # bytes of a table that may be broadcast


@dataclass
class Mix:
    """``documents``: every row with its source's number, size and start in the
    source's words; ``sources``: size, target and blocks; ``slots``: what each
    slot of each shard takes."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """(shard, slot, at, row, first, words): the words of documents that a
        slot holds from its place ``at`` on."""
        b = F.lit(self.block).cast("long")
        own = self.documents.where("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        low = F.col("block") * b
        own = own.select("source", "block", "row", "start", F.greatest("start", low).alias("lo"), F.least(F.col("start") + F.col("size"), low + b).alias("hi"))
        met = self.slots.select("source", "block", "shard", "slot", "words").join(own, ["source", "block"])
        words = F.least("hi", F.col("block") * b + F.col("words")) - F.col("lo")
        return met.where(words > 0).select("shard", "slot", (F.col("lo") - F.col("block") * b).alias("at"), "row", (F.col("lo") - F.col("start")).alias("first"), words.alias("words"))


def _fifth(x: Column) -> Column:
    """x to the fifth, modulo PRIME: a permutation of its residues."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def drawn(number: Column, below: Column) -> Column:
    """A pseudorandom number below ``below`` for each number."""
    one = _fifth((number % PRIME * 48271 + F.floor(number / PRIME) * 69621 + 11) % PRIME)
    two = _fifth((one * 16807 + number % PRIME + 7) % PRIME)
    return (one * PRIME + two) % below


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 to n - 1: in each round
    x and its partner change places or not, by a bit that both share."""

    def round_(x: Column, c: Column) -> Column:
        partner = F.pmod(seed * c % PRIME % n - x, n)
        mark = (F.greatest(x, partner) % PRIME * c + seed) % PRIME
        return F.when(mark * mark % PRIME % 2 == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(c).cast("long") for c in ROUNDS]), x.cast("long"), round_)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return saved(df, f"mix-{name}")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """With a broadcast hint if its rows, written already, are few enough."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= SMALL else df


def _located(points: DataFrame, at: str, ranges: DataFrame, total: int) -> DataFrame:
    """Points joined with the range (``low``, ``many``) that holds them; ranges
    do not overlap. Both meet in cells of the line of ``total`` numbers."""
    cell = max(64, -(-total // CELLS))
    ranges = ranges.where("many > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("low") + F.col("many") - 1) / cell))))
    points = points.withColumn("cell", F.floor(F.col(at) / cell))
    return points.join(ranges, "cell").where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("low") + F.col("many"))).drop("cell")


def targets(sources: DataFrame, most: int) -> DataFrame:
    """``sources`` (source, name, size, weight; written) with ``target`` and its
    whole words ``aim``. The rounds of sharing read sums alone."""
    cap = F.col("size") * most
    total, weights = sources.agg(F.sum("size"), F.sum("weight")).first()
    total, weights = int(total or 0), int(weights or 1)
    left, by, stopped = total, weights, 0
    above = F.lit(False)
    while total:
        above = F.col("weight").cast("decimal(38,0)") * left > cap.cast("decimal(38,0)") * by
        r = sources.where(above).agg(F.count(F.lit(1)), F.sum(cap), F.sum("weight")).first()
        if r[0] == stopped:
            break
        stopped, left, by = r[0], total - int(r[1]), weights - int(r[2])
    return sources.select("*", F.when(above, cap.cast("double")).otherwise((F.col("weight") * left).cast("double") / by).alias("target"),
                          F.when(above, cap).otherwise(F.expr(f"weight * {left}L div {by}L")).alias("aim"))


def mix(docs: DataFrame, block: int = 256, shard: int = 1024, most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("name"),
                       F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = _numbered(rows, "sizes")
    sources = rows.groupBy("name").agg(F.sum("size").alias("size"))
    sources = running_sum(sources, [], [F.col("name").isNull(), F.col("name")], "source")
    sources = _numbered(sources.withColumn("weight", F.col("source") % 3 + 1), "sources")
    sources = targets(sources, most)
    b = F.lit(block).cast("long")
    sources = sources.withColumn("blocks", F.ceil(F.col("size") / b)).withColumn("full", F.floor(F.col("size") / b))
    slots = F.when(F.col("size") > 0, F.expr("aim div size") * F.col("blocks") + F.ceil(F.expr("aim % size") / b)).otherwise(0)
    sources = _numbered(running_sum(sources.withColumn("many", slots), [], ["source"], "low", "many"), "targets")
    names = _small(sources.select("name", "source").withColumnRenamed("name", "_name"), F.coalesce(F.octet_length("_name"), F.lit(0)) + 16)
    own = rows.join(names, F.col("name").eqNullSafe(F.col("_name"))).drop("_name")
    own = running_sum(own, ["source"], ["key", "size"], "start", "size")
    return Mix(_numbered(own, "documents"), sources, _slots(docs, sources, block, shard), block)


def _slots(docs: DataFrame, sources: DataFrame, block: int, shard: int) -> DataFrame:
    """(shard, slot, source, epoch, block, words) of every slot."""
    total = int(sources.agg(F.sum("many")).first()[0] or 0)
    slots = docs.sparkSession.range(total).select(F.col("id").alias("number"), F.floor(F.col("id") / shard).alias("shard"), (F.col("id") % shard).alias("slot"))
    slots = slots.withColumn("point", drawn(F.col("number"), F.lit(max(1, total)).cast("long")))
    slots = _located(slots, "point", sources.select("source", "low", "many"), total).select("shard", "slot", "source")
    counts = _numbered(slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n")), "counts")
    offsets = running_sum(counts, ["source"], ["shard"], "offset", "n").select("shard", "source", "offset")
    inside = Window.partitionBy("shard", "source").orderBy("slot")  # at most a shard
    slots = slots.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "source"])
    slots = slots.select("shard", "slot", "source", (F.col("rank") + F.col("offset")).alias("rank"))
    # what was drawn beyond a source's number goes to those below theirs
    drawn_ = counts.groupBy("source").agg(F.sum("n").alias("drawn"))
    plan = sources.select("source", "size", "aim", "blocks", "full", "many").join(drawn_, "source", "left").na.fill({"drawn": 0})
    plan = plan.withColumn("over", F.greatest(F.col("drawn") - F.col("many"), F.lit(0))).withColumn("under", F.greatest(F.col("many") - F.col("drawn"), F.lit(0)))
    plan = running_sum(running_sum(plan, [], ["source"], "over_before", "over"), [], ["source"], "under_before", "under")
    plan = _numbered(plan, "plan")
    small = _small(plan, F.lit(100))
    slots = _numbered(slots.join(small.select("source", "many", "over_before"), "source"), "slots")
    kept = slots.where("rank < many").select("shard", "slot", "source", "rank")
    moved = slots.where("rank >= many").select("shard", "slot", (F.col("over_before") + F.col("rank") - F.col("many")).alias("point"))
    lacking = plan.select("source", F.col("under_before").alias("low"), F.col("under").alias("many"), "drawn")
    moved = _located(moved, "point", lacking, total).select("shard", "slot", "source", (F.col("drawn") + F.col("point") - F.col("low")).alias("rank"))
    slots = kept.unionByName(moved).join(small.select("source", "size", "aim", "blocks", "full"), "source")
    slots = slots.withColumn("epoch", F.expr("rank div blocks")).withColumn("place", F.col("rank") % F.col("blocks"))
    seed = _fifth((F.col("source") * 8 + F.col("epoch") + 3) % PRIME)
    slots = slots.withColumn("seed", seed).withColumn("block", F.when(F.col("place") < F.col("full"), permuted(F.col("place"), F.col("full"), F.col("seed"))).otherwise(F.col("place")))
    before = F.col("epoch") * F.col("size") + F.col("place") * block
    words = F.least(F.lit(block), F.col("size") - F.col("block") * block, F.col("aim") - before)
    return slots.select("shard", "slot", "source", "epoch", "block", words.alias("words"))


def taken(docs: DataFrame, block: int = 256, shard: int = 1024, most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken) of every row."""
    m = mix(docs, block, shard, most, key, text, source)
    sums = m.pieces().groupBy("row").agg(F.sum("words").alias("taken"))
    own = _small(m.sources.select("source", F.col("size").alias("source_size"), "target"), F.lit(32))
    out = m.documents.join(sums, "row", "left").join(own, "source")
    return saved(out.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")), "mixed")
