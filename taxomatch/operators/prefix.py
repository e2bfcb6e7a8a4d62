"""Running sums and ranks over any number of rows, without a window that holds
a whole group.

Rows are sorted by range, so a group of any size is dealt over many tasks, and
written once: the places of the rows are then fixed for both steps. Each piece
of a group in one task sums by itself; the pieces of a group, at most one per
task, are summed by a window over the pieces alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.session import scratch_dir


def running_sum(df: DataFrame, by: list[str], order: list[Column | str], out: str, value: str | None = None, tasks: int | None = None,
                total: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (or the number of rows) before
    the row among the rows of its ``by`` columns, in ``order``; nulls of ``by``
    are one group. Rows equal in ``order`` stand in any one order. ``total``
    names a column for the sum over all rows of the group.

    Without ``value`` a row's place in its task gives its number, so no window
    over rows is needed."""
    spark = df.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    # equal rows may be more than a task should hold: their input places part them
    rows = df.withColumn("_salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(tasks, *keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt")
    path = scratch_dir(spark, "running-sum")
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path).withColumn("_piece", F.shiftright("_at", 33))
    pieces = rows.groupBy(*by, "_piece").agg(F.min("_at").alias("_first"), (F.sum(value) if value else F.count(F.lit(1))).alias("_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per task
    earlier = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_piece").alias("_p"), "_first",
                           F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
                           *([F.sum("_sum").over(group).alias("_total")] if total else []))
    if value:
        own = Window.partitionBy(*by, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    same = F.col("_piece") == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = F.col("_own") if value else F.col("_at") - F.col("_first")
    return rows.join(pieces, same).select(*df.columns, (F.col("_before") + inside).alias(out), *([F.col("_total").alias(total)] if total else []))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a frame with several
    readers is computed once and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
