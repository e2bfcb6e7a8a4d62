"""Group-wise vector aggregates: weighted centroid and plain mean.

Each vector is scaled by its weight and summed by ``Summarizer``: one buffer of
the vector's width per key and map task, so a hot key is pre-aggregated before
the shuffle and no vector is taken apart. Weights may be negative, so they are
multiplied in rather than passed as the summarizer's own weights.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _weight(w):
    return F.lit(1.0) if w is None else (F.col(w) if isinstance(w, str) else w).cast("double")


def centroids(df: DataFrame, keys, vec: str, outs: dict) -> DataFrame:
    """Several weighted centroids ``sum_i w_i v_i / sum_i w_i`` of the same
    vectors in one pass: ``outs`` maps output name -> weight column (None: plain
    mean). Rows with a null vector are skipped; a key whose weights sum to 0
    gets the zero vector (the reference would give NaN)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = df.where(F.col(vec).isNotNull()).select(*keys, F.col(vec).cast("array<double>").alias("_v"),
                                                  *[_weight(w).alias(f"_w_{o}") for o, w in outs.items()])
    aggs = []
    for o, w in outs.items():
        scaled = F.col("_v") if w is None else F.transform("_v", _times(f"_w_{o}"))
        aggs += [Summarizer.sum(array_to_vector(scaled)).alias(f"_s_{o}"), F.sum(f"_w_{o}").alias(f"_n_{o}")]
    sums = src.groupBy(*keys).agg(*aggs)
    return sums.select(*keys, *[F.transform(vector_to_array(f"_s_{o}"), _share(f"_n_{o}")).alias(o) for o in outs])


def _times(weight):
    return lambda x: x * F.col(weight)


def _share(total):
    return lambda x: F.when(F.col(total) != 0, x / F.col(total)).otherwise(F.lit(0.0))


def weighted_centroid(df: DataFrame, keys, vec: str, weight=None, out: str = "centroid", skip_blank=None) -> DataFrame:
    """One centroid per key; rows where ``skip_blank`` (a boolean column) is
    true are skipped. ``weight=None`` is the plain mean."""
    return centroids(df if skip_blank is None else df.where(~skip_blank), keys, vec, {out: weight})


def vector_mean(df: DataFrame, keys, vec: str, out: str = "mean") -> DataFrame:
    """Unweighted mean per key, not re-normalised (chunk mean)."""
    return weighted_centroid(df, keys, vec, None, out)
