"""Embedding near-duplicates by E8 lattice hashing.

In each table a random orthonormal map takes the unit vector to eight
dimensions, and the point is decoded to its nearest E8 lattice point, its home
cell. It also probes the neighbouring cells (home plus a shortest lattice
vector) nearest to it. Two vectors meet where the home of one is the home or a
probe of the other; every pair that meets is verified by cosine in double
precision, and there is no cap on a cell: one with more than TILE rows is cut
into tiles and every pair of its tiles is compared by a task of its own.

A pair may meet several times; it counts only where it meets first, which both
ends' cells tell, so links are counted without listing them. A tile pair also
returns a forest of its links for the components. Equal vectors are one class
with its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and keep their row; vectors of other lengths never
link; rows with the same id and vector are separate members of one class, so
they link with each other; a null id is a member like any other, and its component id
is the smallest known id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import map_arrow, saved
from taxomatch.llm.components import components, forest

TABLES = 3
PROBES = 6
CELL = 0.16  # lattice scale for unit vectors: the recall at cosine 0.95 is above 0.99
TILE = 2048
GROUP_ROWS = 8192  # rows that one task group holds, on average


@lru_cache
def shortest() -> np.ndarray:
    """The shortest vectors of E8: two entries of +-1, or eight of +-1/2 with
    an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer entries of even sum."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - y[odd]
        k = np.abs(off).argmax(axis=1)
        y[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return y


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    far = ((x - a) ** 2).sum(axis=1) > ((x - b) ** 2).sum(axis=1)
    return np.where(far[:, None], b, a)


@lru_cache
def maps(dim: int, tables: int, seed: int) -> np.ndarray:
    """(dim, 8 * tables): orthonormal columns per table, disjoint as far as
    the dimension allows. Shorter vectors get plain Gaussian columns."""
    rng = np.random.default_rng([seed, dim])
    if dim < 8:
        return rng.standard_normal((dim, 8 * tables)) / np.sqrt(dim)
    per = dim // 8
    blocks = []
    while len(blocks) < tables:
        q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        blocks += [q[:, 8 * k:8 * k + 8] for k in range(per)]
    return np.concatenate(blocks[:tables], axis=1)


def cells(unit: np.ndarray, tables: int, probes: int, cell: float, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) cell hashes, the home cell first."""
    dim = unit.shape[1]
    # einsum without BLAS: a row's result does not depend on the other rows
    flat = np.einsum("nd,dk->nk", unit, maps(dim, tables, seed), optimize=False) * (np.sqrt(dim / 64) / cell)
    roots = shortest()
    rng = np.random.default_rng([seed, 8])
    weight = rng.integers(1, 1 << 63, (tables, 8), np.uint64) | np.uint64(1)
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    for t in range(tables):
        x = flat[:, 8 * t:8 * t + 8]
        home = decode(x)
        gain = np.einsum("nk,rk->nr", x - home, roots, optimize=False)
        near = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + roots[near]], axis=1)
        whole = np.rint(2 * points).astype(np.int64).view(np.uint64)
        h = np.zeros(whole.shape[:2], np.uint64)
        with np.errstate(over="ignore"):
            for k in range(8):
                h = (h ^ (whole[:, :, k] * weight[t, k])) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        out[:, t] = h
    return out


def valid(vector: str) -> Column:
    """Whether a vector can take part in comparisons."""
    return F.expr(f"coalesce(size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
                  f" and exists(`{vector}`, x -> x <> 0), false)")


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every vector length of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    size = np.diff(ends, prepend=0)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, values[(ends[rows] - n)[:, None] + np.arange(n)]


class Meeting:
    """The pairs of one cell (or of two of its tiles) that meet there first."""

    def __init__(self, threshold: float, probes: int, cell: float, tables: int, seed: int):
        self.threshold, self.codes = threshold, lambda u: cells(u, tables, probes, cell, seed)

    def first(self, codes: np.ndarray, cid: np.ndarray, p: np.ndarray, q: np.ndarray, table: int, here: np.uint64) -> np.ndarray:
        """Whether the pairs (p, q) meet first in this table and cell."""
        swap = cid[p] > cid[q]
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        own = np.ones(len(p), bool)
        for t in range(table + 1):
            hp, hq = codes[p, t, 0], codes[q, t, 0]
            at_p, at_q = (codes[q, t] == hp[:, None]).any(axis=1), (codes[p, t] == hq[:, None]).any(axis=1)
            if t < table:
                own &= ~(at_p | at_q)
            else:
                own &= np.where(at_p, hp, hq) == here
        return own

    def pairs(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray, cid: np.ndarray, home: np.ndarray, side: np.ndarray,
              table: int, here: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of linked pairs of rows. side: 0 for a cell's only or first
        tile, 1 for the second."""
        two = bool(side.any())
        for a, b in ((home & (side == 0), side == 1), (~home & (side == 0), home & (side == 1))) if two else ((home, np.ones(len(home), bool)),):
            a, b = np.flatnonzero(a), np.flatnonzero(b)
            if not len(a) or not len(b):
                continue
            step = max(1, (1 << 17) // len(b))
            for lo in range(0, len(a), step):
                near = unit[a[lo:lo + step]] @ unit[b].T
                i, j = np.nonzero(near >= self.threshold - 1e-5)
                p, q, near = a[lo + i], b[j], near[i, j]
                if not two:  # two homes once, and no row with itself
                    once = (p < q) | ((p != q) & ~home[q])
                    p, q, near = p[once], q[once], near[once]
                exact = near >= self.threshold + 1e-5
                if not exact.all():
                    k = np.flatnonzero(~exact)
                    u, v = x[p[k]], x[q[k]]
                    exact[k] = (u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1)) >= self.threshold
                    p, q = p[exact], q[exact]
                if len(p):
                    own = self.first(codes, cid, p, q, table, here)
                    p, q = p[own], q[own]
                if len(p):
                    yield p, q


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding",
                    tables: int = TABLES, probes: int = PROBES, cell: float = CELL, tile: int = TILE, seed: int = 8) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    item = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "<f4" if item == "float" else "<f8"
    rows = vectors.select(key, F.when(valid(vector), F.col(vector)).alias("v"))
    kinds = rows.where("v is not null").groupBy("v").agg(F.min(key).alias("least"), F.count("*").alias("size"))
    kinds = saved(kinds.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    kinds = kinds.repartition(kinds.sparkSession.sparkContext.defaultParallelism * 4, "cid")

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, size = (batch.column(c).to_numpy() for c in ("cid", "size"))
            for at, x in by_length(batch.column("v")):
                for lo in range(0, len(at), 4096):
                    own = at[lo:lo + 4096]
                    c = cells(unit_rows(x[lo:lo + 4096]), tables, probes, cell, seed)
                    raw = x[lo:lo + 4096].astype(kind)
                    n = tables * (1 + probes)
                    take = np.repeat(np.arange(len(own)), n)
                    blob = pa.array([r.tobytes() for r in raw], pa.binary()).take(pa.array(take))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(own))), pa.array(c.reshape(-1).view(np.int64)),
                         pa.array(np.tile(np.arange(1 + probes) == 0, tables * len(own))), pa.array(cid[own][take]), pa.array(size[own][take]), blob],
                        names=["t", "cell", "home", "cid", "size", "vec"])

    probing_rows = map_arrow(kinds.select("cid", "size", "v"), probing, "t int, cell long, home boolean, cid long, size long, vec binary")
    hot = saved(probing_rows.groupBy("cell").count().where(F.col("count") > tile)
                .select("cell", F.ceil(F.col("count") / tile).alias("tiles")), "hot-cells")
    n_hot = hot.count()
    spread = probing_rows.withColumns({"ti": F.lit(0).cast("long"), "tj": F.lit(0).cast("long"), "side": F.lit(0)})
    if n_hot:  # changes the plan only: cells that are cut meet tile by tile
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        spread = probing_rows.join(hot, "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        spread = spread.withColumn("own", F.pmod(F.xxhash64("cid"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        spread = spread.select("t", "cell", "home", "cid", "size", "vec", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"),
                               (F.col("own") > F.col("other")).cast("int").alias("side"))
    total = kinds.count() * tables * (1 + probes)
    groups = max(1, -(-total // GROUP_ROWS))
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("cell", "ti", "tj"), F.lit(groups)))

    def compare(group: pa.Table) -> pa.Table:
        meet = Meeting(threshold, probes, cell, tables, seed)
        col = lambda c: group.column(c).to_numpy()
        t, cell_id, cid, size, ti, tj, side, home = (col(c) for c in ("t", "cell", "cid", "size", "ti", "tj", "side", "home"))
        raw = group.column("vec").to_pylist()
        length = np.array([len(r) for r in raw])
        order = np.lexsort((cid, length, tj, ti, cell_id))
        new = np.ones(len(order), bool)
        new[1:] = False
        for c in (length, tj, ti, cell_id):
            new[1:] |= c[order][1:] != c[order][:-1]
        starts = np.flatnonzero(new).tolist()
        out = {"cid": [], "n": [], "other": []}
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            k = order[lo:hi]
            if hi - lo < 2 or not home[k].any():
                continue
            x = np.frombuffer(b"".join([raw[r] for r in k]), kind).reshape(len(k), -1).astype(np.float64)
            unit = unit_rows(x)
            near = unit.astype(np.float32)
            # most cells hold no near pair: look before the cells are derived again
            if len(k) <= 256 and not (np.triu(near @ near.T, 1) >= threshold - 1e-5).any():
                continue
            found = np.zeros(len(k), np.int64)
            us, vs = [], []
            for p, q in meet.pairs(x, near, meet.codes(unit), cid[k], home[k], side[k], int(t[k[0]]), cell_id[k[0]].view(np.uint64)):
                np.add.at(found, p, size[k][q])
                np.add.at(found, q, size[k][p])
                u, v = forest(len(k), p, q)
                us.append(u)
                vs.append(v)
            if us:
                u, v = forest(len(k), np.concatenate(us), np.concatenate(vs))
                some = np.flatnonzero(found)
                out["cid"] += [cid[k][some], cid[k][u]]
                out["n"] += [found[some], np.zeros(len(u), np.int64)]
                out["other"] += [np.full(len(some), -1), cid[k][v]]
        return pa.table({c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()})

    found = saved(spread.groupBy("bucket").applyInArrow(compare, "cid long, n long, other long"), "vector-links")
    joined = components(found.where("other >= 0"), "cid", "other").withColumnRenamed("node", "cid")
    counts = found.where("other < 0").groupBy("cid").agg(F.sum("n").alias("n"))
    label = kinds.join(joined, "cid", "left").join(counts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    best = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.join(best, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "v", "left").select(key, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                                                  F.when(F.col("v").isNull(), F.col(key)).otherwise(F.col("component_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
