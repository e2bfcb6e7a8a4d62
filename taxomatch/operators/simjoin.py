"""Exact top-k inner products against a knowledge base of any size.

KB vectors are dealt to blocks around pivots, near ones together. A block's
centre c and radius r bound every product in it: q.v <= q.c + r|q|. A query
first meets the block of the highest q.c; its k-th best product there is
carried along, and the query goes on only to blocks whose bound reaches it. So
no query is copied to every block, and nothing that could be among the k best is
left out.

Bounds: pivots and centres are the only vectors that are broadcast; there are
at most PIVOTS and MOST_BLOCKS of them. A block holds about ``block_rows``
vectors, a group of queries ``query_rows``; both meet as one co-group.

Queries of zero have the product 0 with every vector: they get the lowest codes
at once. Products equal to 12 decimals are ties and go to the lower code, then
to the earlier row of the KB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.session import scratch_dir, ship_package

PIVOTS = 256
MOST_BLOCKS = 20_000
SLACK = 1e-9
DECIMALS = 12


def matrix(column, dim: int) -> np.ndarray:
    """A list column as rows of a matrix; null and empty lists are zero, any
    other width than ``dim`` is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    wrong = size[(size != dim) & (size != 0)]
    if len(wrong):
        raise ValueError(f"a vector has {wrong[0]} components, the knowledge base has {dim}")
    flat = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(size) * dim:
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[size > 0] = flat.reshape(-1, dim)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1), pa.int32()) if m.size else pa.array([0] * (len(m) + 1), pa.int32()), pa.array(m.reshape(-1)))


class SimilarityJoin:
    """A KB made ready: written blocks, and their centres and radii."""

    def __init__(self, kb: DataFrame, code: str = "code", vec: str = "vec", block_rows: int = 4096, query_rows: int = 8192):
        self.spark, self.query_rows = kb.sparkSession, query_rows
        ship_package(self.spark)
        rows = self._written(kb.select(F.col(code).cast("string").alias("code"), F.col(vec).cast("array<double>").alias("kv")).withColumn("kb_row", F.monotonically_increasing_id()), "kb")
        self.n, self.dim = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.max(F.size("kv"))).first())
        per_block = max(block_rows, -(-self.n // (MOST_BLOCKS // 2)))
        wanted = min(PIVOTS, max(1, -(-self.n // per_block)))
        some = rows.orderBy(F.xxhash64("kb_row")).limit(wanted).select("kv").toArrow()  # at most PIVOTS vectors
        pivots, dim = matrix(some.column(0), self.dim), self.dim

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = matrix(b.column("kv"), dim)
                pivot = np.argmin((pivots ** 2).sum(axis=1) - 2 * m @ pivots.T, axis=1) if len(pivots) else np.zeros(len(m), np.int64)
                yield pa.RecordBatch.from_arrays([b.column("code"), _lists(m), b.column("kb_row"), pa.array(pivot, pa.int32())], names=["code", "kv", "kb_row", "pivot"])

        rows = self._written(rows.mapInArrow(near, "code string, kv array<double>, kb_row long, pivot int"), "kb-near")
        # a pivot with more rows than a block holds has several blocks
        many = rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("parts"))  # a row per pivot
        block = F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("kb_row"), F.col("parts"))
        rows = rows.join(F.broadcast(many), "pivot").select(block.alias("block"), "code", "kv", "kb_row")
        self.blocks = self._written(rows, "kb-blocks")

        def ball(group: pa.Table) -> pa.Table:
            m = matrix(group.column("kv"), dim)
            centre = m.mean(axis=0)
            return pa.table({"block": group.column("block")[:1], "centre": _lists(centre[None, :]), "radius": [float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))]})

        balls = self.blocks.groupBy("block").applyInArrow(ball, "block long, centre array<double>, radius double").toArrow()  # at most MOST_BLOCKS and a pivot's rest each
        self.ids, self.centres, self.radii = balls.column("block").to_numpy(), matrix(balls.column("centre"), dim), balls.column("radius").to_numpy()
        order = np.argsort(self.ids)
        self.ids, self.centres, self.radii = self.ids[order], self.centres[order], self.radii[order]

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(self.spark, f"similarity-{name}")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def topk(self, queries: DataFrame, k: int = 3, vec: str = "vec") -> DataFrame:
        """The columns of ``queries`` but the vector, with rank, code and score,
        a row for each of the ``k`` best KB rows by cosine weight (the query's
        vector is scaled to length 1). ``visits``: (query, block) pairs met."""
        kept = [c for c in queries.columns if c != vec]
        q = self._written(queries.select(*kept, F.col(vec).cast("array<double>").alias("_qv")).withColumn("_row", F.monotonically_increasing_id()), "queries")
        ids, centres, radii, dim = (self.spark.sparkContext.broadcast(x) for x in (self.ids, self.centres, self.radii, self.dim))

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not dim.value:  # no KB vector has a component: all products are 0
                    continue
                m = unit(matrix(b.column("_qv"), dim.value))
                some = np.flatnonzero(m.any(axis=1))
                best = ids.value[np.argmax(m[some] @ centres.value.T, axis=1)]
                yield pa.RecordBatch.from_arrays([b.column("_row").take(pa.array(some)), _lists(m[some]), pa.array(best, pa.int64()), pa.array(np.full(len(some), -np.inf))], names=["_row", "qv", "block", "least"])

        def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = matrix(b.column("qv"), dim.value)
                for lo in range(0, len(m), 512):
                    part = m[lo:lo + 512]
                    least, at = b.column("least").to_numpy(zero_copy_only=False)[lo:lo + 512], b.column("block").to_numpy()[lo:lo + 512]
                    reach = part @ centres.value.T + radii.value >= (least - SLACK)[:, None]
                    reach &= ids.value != at[:, None]
                    i, j = np.nonzero(reach)
                    yield pa.RecordBatch.from_arrays([b.column("_row").slice(lo, 512).take(pa.array(i)), _lists(part[i]), pa.array(ids.value[j], pa.int64()), pa.array(least[i])], names=["_row", "qv", "block", "least"])

        sent = "_row long, qv array<double>, block long, least double"
        first = self._written(q.select("_row", "_qv").mapInArrow(home, sent), "home")
        found = self._written(self._met(first, k), "first")
        order = Window.partitionBy("_row").orderBy(F.desc(F.round("score", DECIMALS)), "code", "kb_row")
        kth = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("_row", "score")
        more = first.join(kth, "_row", "left").select("_row", "qv", "block", F.coalesce("score", F.lit(float("-inf"))).alias("least")).mapInArrow(onward, sent)
        more = self._written(more, "onward")
        self.visits = first.select("_row", "block").unionByName(more.select("_row", "block"))
        best = found.unionByName(self._met(more, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        rest = q.drop("_qv")
        out = rest.join(best, "_row").select(*kept, "rank", "code", "score")
        # queries of zero
        lowest = self.blocks.orderBy("code", "kb_row").limit(k).select("code").collect()  # k codes
        zero = rest.join(first.select("_row"), "_row", "left_anti")
        codes = F.array(*[F.lit(r["code"]) for r in lowest]).cast("array<string>")
        return out.unionByName(zero.select(*kept, F.posexplode(codes).alias("rank", "code")).select(*kept, (F.col("rank") + 1).alias("rank"), "code", F.lit(0.0).alias("score")))

    def _met(self, sent: DataFrame, k: int) -> DataFrame:
        """(_row, code, kb_row, score): the best ``k`` of a block for each query
        sent to it, none below its carried product."""
        dim = self.dim
        groups = sent.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / self.query_rows).alias("_parts"))  # a row per block
        dealt = sent.join(F.broadcast(groups), "block").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts")
        kb = self.blocks.join(F.broadcast(groups), "block").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")

        def products(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, names, at, score = [], [], [], []
            if left.num_rows and right.num_rows:
                order = pc.sort_indices(right, [("code", "ascending"), ("kb_row", "ascending")])
                right = right.take(order)
                q, v, least = matrix(left.column("qv"), dim), matrix(right.column("kv"), dim), left.column("least").to_numpy()
                step = max(1, (1 << 23) // len(v))
                for lo in range(0, len(q), step):
                    p = q[lo:lo + step] @ v.T
                    shown = np.round(p, DECIMALS)
                    # rows stand in tie order, so a stable sort of those from the k-th value on is exact
                    kth = np.partition(shown, -k, axis=1)[:, -k] if shown.shape[1] > k else np.full(len(p), -np.inf)
                    i, j = np.nonzero((shown >= kth[:, None]) & (p >= (least[lo:lo + step] - SLACK)[:, None]))
                    by = np.lexsort([j, -shown[i, j], i])
                    i, j = i[by], j[by]
                    first = np.searchsorted(i, i)
                    keep = np.arange(len(i)) - first < k
                    i, j = i[keep], j[keep]
                    rows.append(i + lo)
                    names.append(j)
                    score.append(p[i, j])
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, names))
            return pa.table({"_row": left.column("_row").take(pa.array(i)), "code": right.column("code").take(pa.array(j)), "kb_row": right.column("kb_row").take(pa.array(j)),
                             "score": np.concatenate(score) if score else np.zeros(0)})

        return dealt.groupBy("block", "_part").cogroup(kb.groupBy("block", "_part")).applyInArrow(products, "_row long, code string, kb_row long, score double")
