"""Connected components by randomised contraction."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import saved


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs that connect what the pairs (a, b) of nodes below n
    connect: every node with the smallest one of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its
    smallest node. Null ends, loops and repeated edges are ignored.

    A round contracts every node into the neighbour that comes first in that
    round's order (ids under a random mask), so the edges shrink by a constant
    factor on average whatever the shape; the rounds are then replayed on the
    nodes. Each round is a grouping with map-side minimum and two joins, written
    to the shared folder.
    """
    live = saved(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    rng, rounds = random.Random(20), []
    while not live.isEmpty():
        mask = rng.getrandbits(62)
        order = lambda c: F.col(c).bitwiseXOR(F.lit(mask))
        both = live.select(order("a").alias("u"), order("b").alias("v")).unionAll(live.select(order("b").alias("u"), order("a").alias("v")))
        near = both.groupBy("u").agg(F.least("u", F.min("v")).alias("v"))
        near = saved(near.select(order("u").alias("node"), order("v").alias("into")), "contract")
        rounds.append(near)
        live = live.join(near.toDF("a", "a2"), "a").join(near.toDF("b", "b2"), "b")
        live = live.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct()
        live = saved(live, "edges")
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[0].select("node", F.col("into").alias("at"))
    for near in rounds[1:]:
        out = out.join(near.toDF("at", "into"), "at", "left").select("node", F.coalesce("into", "at").alias("at"))
    out = saved(out, "component")
    least = out.groupBy("at").agg(F.min("node").alias("component"))
    return out.join(least, "at").select("node", "component")
