"""Exact nearest neighbours by a block matrix join.

Vectors are scaled to unit length and quantised to int8 with a step per vector.
A block of queries meets a block of candidates as one int8 product tile (held
in float32, where sums of int8 products are exact); the norm of each vector's
quantisation error bounds how far the tile can be off. A pair survives if its
upper bound reaches the k-th best lower bound seen for its query. Survivors are
recomputed in double precision from the original vectors and kept in a heap of
k per query. Blocks are dealt by (query block, candidate block), so no task
holds more than one block of each, and the heaps are merged by rank.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; vectors of another length
are no candidates; rows that share an id are rows of their own, as queries and
as candidates of each other; equal scores go to the smaller id; fewer candidates
give fewer rows; an empty table gives an empty result; a vector of any length is
held whole; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from taxomatch.llm.common import map_arrow, saved
from taxomatch.llm.lattice import by_length, valid

QUERIES = 1024  # rows of a query block
CANDIDATES = 4096  # rows of a candidate block
BLOCK = "dim int, rows binary, ids binary, vecs binary, codes binary, steps binary, errors binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, step, norm of the error) of the rows' unit vectors."""
    top = np.abs(x).max(axis=1, keepdims=True)
    unit = x / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * step[:, None]) ** 2).sum(axis=1))
    return codes, step, error


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component on."""
    dot, a, b = np.zeros((3, len(x)))
    for u, v in zip(x.T, y.T, strict=True):
        dot += u * v
        a += u * u
        b += v * v
    return dot / (np.sqrt(a) * np.sqrt(b))


class Heaps:
    """The k best (score, id) of every query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)  # the k-th best so far

    def offer(self, row: int, found: list[tuple[float, int]]) -> None:
        heap = self.heaps[row]
        for s, v in found:
            item = (s, -v)  # the smaller id wins a tie
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.floor[row] = heap[0][0]


def search_tile(heaps: Heaps, q: dict, c: dict) -> None:
    """Offer the surviving pairs of a query block and a candidate block."""
    wide = np.float32 if q["x"].shape[1] <= 1000 else np.float64  # 1000 * 127 ** 2 < 2 ** 24
    tile = (q["codes"].astype(wide) @ c["codes"].astype(wide).T).astype(np.float64)
    tile *= q["step"][:, None]
    tile *= c["step"]
    # |x.y - x'.y'| <= |x'||y - y'| + |x - x'||y'| + |x - x'||y - y'|, and |x'| <= 1 + |x - x'|
    off = np.multiply.outer(1 + q["error"], c["error"]) + np.multiply.outer(q["error"], 1 + c["error"]) + np.multiply.outer(q["error"], c["error"]) + 1e-9
    own = q["rows"][:, None] == c["rows"]
    low = np.where(own, -np.inf, tile - off)
    if low.shape[1] > heaps.k:
        floor = np.partition(low, low.shape[1] - heaps.k, axis=1)[:, low.shape[1] - heaps.k]
    else:
        floor = np.full(len(low), -np.inf)
    floor = np.maximum(floor, heaps.floor)
    i, j = np.nonzero((tile + off >= floor[:, None]) & ~own)
    if not len(i):
        return
    score = cosine(q["x"][i], c["x"][j])
    ends = np.searchsorted(i, np.arange(len(low) + 1))
    names = c["ids"][j].tolist()
    score = score.tolist()
    for row in np.unique(i).tolist():
        heaps.offer(row, list(zip(score[ends[row]:ends[row + 1]], names[ends[row]:ends[row + 1]], strict=True)))


def block_of(batch: pa.RecordBatch, prefix: str, row: int) -> dict:
    get = lambda c, kind: np.frombuffer(batch.column(prefix + c)[row].as_py(), kind)
    dim = batch.column("dim")[row].as_py()
    return {"rows": get("rows", "<i8"), "ids": get("ids", "<i8"), "x": get("vecs", "<f8").reshape(-1, dim), "codes": get("codes", "i1").reshape(-1, dim),
            "step": get("steps", "<f8"), "error": get("errors", "<f8")}


def blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """One row per block of at most ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            codes, step, error = quantise(x)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (rows.astype("<i8"), ids.astype("<i8"), x.astype("<f8"), codes, step, error)]],
                names=["dim", "rows", "ids", "vecs", "codes", "steps", "errors"])

        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, x in by_length(batch.column(2)):
                parts = held.setdefault(x.shape[1], [])
                parts.append((rows[at], ids[at], x))
                if sum(len(i) for i, *_ in parts) >= size:
                    r, i, x = (np.concatenate(p) for p in zip(*parts, strict=True))
                    whole = len(i) // size * size
                    for lo in range(0, whole, size):
                        yield out(x.shape[1], r[lo:lo + size], i[lo:lo + size], x[lo:lo + size])
                    held[x.shape[1]] = [(r[whole:], i[whole:], x[whole:])]
        for dim, parts in held.items():
            r, i, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            if len(i):
                yield out(dim, r, i, x)

    return map_arrow(rows.select("_row", key, "v"), run, BLOCK)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            query_rows: int = QUERIES, candidate_rows: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which
    ``is_query``, a condition on the key, holds."""
    rows = vectors.where(valid(vector) & F.col(key).isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    rows = saved(rows, "vectors")  # the rows' own numbers are fixed from here on
    # each task makes blocks of its own rows, so a task should have some blocks' worth
    n = rows.count()
    queries = rows.where(is_query)
    q = queries.repartition(max(1, -(-queries.count() // query_rows)), "_row")
    c = rows.repartition(max(1, -(-n // candidate_rows)), "_row")
    number = F.monotonically_increasing_id()
    q = saved(blocks(q, key, query_rows).withColumn("qb", number), "query-blocks")
    c = saved(blocks(c, key, candidate_rows).withColumn("cb", number), "candidate-blocks")
    # every candidate block goes to every query block of its length: the block numbers are the grid
    grid = c.select("dim", "cb").join(q.select("dim", "qb"), "dim")
    grid = saved(grid.select("qb", "cb"), "grid")
    pairs = grid.join(c, "cb").join(q.toDF("qdim", *[f"q_{x}" for x in ("rows", "ids", "vecs", "codes", "steps", "errors")], "qb"), "qb")
    pairs = pairs.repartition(max(1, min(grid.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism)), "qb", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                query = block_of(batch, "q_", row)
                heaps = Heaps(query["ids"], k)
                search_tile(heaps, query, block_of(batch, "", row))
                found = [(r, i, -v, s) for r, i, h in zip(query["rows"].tolist(), heaps.ids.tolist(), heaps.heaps, strict=True) for s, v in h]
                if found:
                    r, i, v, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                                                     names=["own", "query_id", "vec_id", "score"])

    found = map_arrow(pairs, run, "own long, query_id long, vec_id long, score double")
    best = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
