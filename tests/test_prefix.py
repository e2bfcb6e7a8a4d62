"""Running sums against a plain loop."""

import random

from pyspark.sql import functions as F

from taxomatch.operators.prefix import running_sum


def plain(rows, value):
    seen, out = {}, []
    for g, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        out.append((g, k, v, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + (v if value else 1)
    return sorted(out, key=repr), seen


def test_sums_and_ranks_with_a_hot_group_and_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), k, rng.randint(0, 5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(5)
    for value in (None, "v"):
        got = running_sum(df, ["g"], ["k"], "before", value, tasks=7, total="all").collect()
        want, sums = plain(rows, value)
        assert sorted(((r.g, r.k, r.v, r.before) for r in got), key=repr) == want
        assert all(r["all"] == sums[r.g] for r in got)


def test_equal_rows_and_no_group(spark):
    df = spark.range(1000).select(F.lit(5).alias("x"), F.lit(2).alias("v"))
    got = running_sum(df, [], ["x"], "before", "v", tasks=4).collect()
    assert sorted(r.before for r in got) == list(range(0, 2000, 2))
    assert running_sum(df.limit(0), ["x"], ["v"], "n").count() == 0


def test_a_hot_group_is_dealt_over_tasks(spark):
    df = spark.range(100_000).select(F.lit(1).alias("g"), "id")
    got = running_sum(df, ["g"], ["id"], "rank", tasks=8)
    sizes = [r["count"] for r in got.groupBy(F.shiftright("rank", 14)).count().collect()]
    assert got.where("rank <> id").count() == 0 and sum(sizes) == 100_000
