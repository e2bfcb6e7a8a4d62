"""Batch report over app-format match results (``Matched_Title``,
``Matched_SOC_Code``, ``Confidence_%``): tiers, histogram, top occupations,
mean confidence by major group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.functions.text import TIER_HIGH, TIER_MODERATE, colour_tier, confidence_tier, major_group, short_label
from taxomatch.session import reliable_checkpoint

CONF = "Confidence_%"


def with_tiers(result: DataFrame, high: float = TIER_HIGH, moderate: float = TIER_MODERATE) -> DataFrame:
    return (result.withColumn("Tier", confidence_tier(F.col(f"`{CONF}`"), high, moderate))
            .withColumn("Colour", colour_tier(F.col(f"`{CONF}`")))
            .withColumn("Major_Group", major_group("Matched_SOC_Code")))


def tier_counts(result: DataFrame, high: float = TIER_HIGH, moderate: float = TIER_MODERATE) -> DataFrame:
    c = F.col(f"`{CONF}`")
    return result.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_if(c >= high).alias("high"),
                      F.count_if((c >= moderate) & (c < high)).alias("moderate"),
                      F.count_if(c < moderate).alias("low"),
                      F.avg(c).alias("avg_conf"))


def top_occupations(result: DataFrame, n: int = 10, label_chars: int = 35) -> DataFrame:
    """Most frequent matched titles (ties by title), with a short label."""
    return (result.groupBy(F.col("Matched_Title").alias("Occupation")).agg(F.count(F.lit(1)).alias("Count"))
            .orderBy(F.desc("Count"), "Occupation").limit(n)
            .withColumn("Short", short_label("Occupation", label_chars)))


def group_confidence(result: DataFrame) -> DataFrame:
    """Mean confidence and row count per major group, ascending mean."""
    return (result.groupBy(major_group("Matched_SOC_Code").alias("Major_Group"))
            .agg(F.avg(F.col(f"`{CONF}`")).alias("Avg_Conf"), F.count(F.lit(1)).alias("Count"))
            .orderBy("Avg_Conf", "Major_Group"))


def histogram(df: DataFrame, column: str, bins: int = 20, weight: str | None = None) -> DataFrame:
    """Equal-width histogram between min and max, last bin closed (numpy
    rules: edges ``lo + i*step``; lo = hi widens the range by 0.5 each side).
    Two scalars reach the driver; empty bins are filled from a ``bins``-row
    range. ``weight``: a column of row counts. Columns: bin (1-based), lo, hi, mid,
    count."""
    c = F.col(f"`{column}`")
    if weight is None:  # the values are counted once; both passes below read the counts
        df = reliable_checkpoint(df.groupBy(c.alias(column)).agg(F.count(F.lit(1)).alias("_rows")))
        weight = "_rows"
    st = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).collect()[0]
    spark = df.sparkSession
    if st["lo"] is None:
        lo, hi = 0.0, 1.0
    else:
        lo, hi = float(st["lo"]), float(st["hi"])
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    x = c.cast("double")
    edge = lambda i: F.lit(i).cast("double") * F.lit(step) + F.lit(lo)
    i0 = F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    # correct float rounding against the exact edges, as numpy does
    i1 = F.when(x < edge(i0), i0 - 1).when((x >= edge(i0 + 1)) & (i0 != bins - 1), i0 + 1).otherwise(i0)
    counts = (df.where(c.isNotNull()).select(i1.alias("i"), F.col(weight).alias("w"))
              .groupBy("i").agg(F.sum("w").alias("count")))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("i"))
    return (frame.join(counts, "i", "left")
            .select((F.col("i") + 1).alias("bin"),
                    (F.col("i").cast("double") * F.lit(step) + F.lit(lo)).alias("lo"),
                    F.when(F.col("i") == bins - 1, F.lit(hi)).otherwise((F.col("i") + 1).cast("double") * F.lit(step) + F.lit(lo)).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .withColumn("mid", (F.col("lo") + F.col("hi")) / 2))


def report(result: DataFrame, bins: int = 20, top: int = 10, label_chars: int = 35, high: float = TIER_HIGH, moderate: float = TIER_MODERATE) -> DataFrame:
    """The whole batch report in one long table (section, item, n, value).

    The matches are read once: confidences have one decimal, so counts per
    (confidence, title, group) are a small table, written to the shared folder,
    and every part is an aggregate of it. Sections: ``summary`` (rows, value =
    mean confidence), ``tier``, ``histogram`` (item = bin number, value = middle),
    ``occupation`` (the ``top`` most frequent, item = label, ``group`` (value =
    mean confidence)."""
    conf = F.col("conf")
    small = reliable_checkpoint(result.groupBy(F.col(f"`{CONF}`").alias("conf"), F.col("Matched_Title").alias("title"),
                                               major_group("Matched_SOC_Code").alias("grp")).agg(F.count(F.lit(1)).alias("n")))
    mean = F.sum(conf * F.col("n")) / F.sum(F.when(conf.isNotNull(), F.col("n")))

    def part(section: str, df: DataFrame, item, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.col("n").cast("long").alias("n"), value.cast("double").alias("value"))

    summary = small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean.alias("m"))
    tiers = small.groupBy(confidence_tier(conf, high, moderate).alias("t")).agg(F.sum("n").alias("n"))
    titles = small.groupBy("title").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "title").limit(top)
    groups = small.groupBy("grp").agg(F.sum("n").alias("n"), mean.alias("m"))
    hist = histogram(small.withColumnRenamed("conf", CONF), CONF, bins, weight="n").withColumnRenamed("count", "n")
    nothing = F.lit(None)
    return (part("summary", summary, F.lit("rows"), F.col("m")).unionAll(part("tier", tiers, F.col("t"), nothing))
            .unionAll(part("histogram", hist, F.col("bin"), F.col("mid"))).unionAll(part("occupation", titles, short_label("title", label_chars), nothing))
            .unionAll(part("group", groups, F.col("grp"), F.col("m"))))
