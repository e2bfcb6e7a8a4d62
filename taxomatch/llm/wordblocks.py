"""Texts as blocks of word numbers, and questions between blocks.

A block holds the documents of up to BLOCK_BYTES of text of one input task: the
distinct words once, and a number per word. Blocks are written once to a table
bucketed by block number, so each later pass reads them where they lie and
joins answers to them without shuffling a text again.

A question goes from a block to a bucket of a hash range and holds every
distinct hash of the block once, so no hash, however frequent, gathers more
than one entry per block in one place. The bucket's answer has one entry for
each hash of the question, in its order.
"""

from __future__ import annotations

import contextlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import delete, map_arrow, raw_texts, resident, text_slices
from taxomatch.session import scratch_dir, ship_package

BLOCK_BYTES = 8 << 20
SCHEMA = "block long, docs long, n_words long, rows binary, sizes binary, ids binary, words binary, lengths binary"
MOST_BUCKETS = 100_000  # Spark's own limit
BUCKET_WORDS = 1_500_000  # words of the input for each bucket


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def numbering() -> defaultdict:
    """A dictionary that numbers its keys in the order of their first look-up."""
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


class Block:
    """A row of the table: ``rows`` are the carried columns of its documents."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.rows = from_ipc(row["rows"])
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.ids = np.frombuffer(row["ids"], "<u4")
        ends = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64)).tolist()
        raw = row["words"]
        self.names = np.frombuffer(raw, np.uint64) if row["lengths"] == b"" else None
        self.words = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.ends = np.cumsum(self.sizes)

    def hashes(self, seed: int) -> np.ndarray:
        """XXH64 of each distinct word; seed 1 is what a hashed block holds."""
        import xxhash

        if self.names is not None:
            return self.names
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)


def blocks(docs: DataFrame, text: str, carry: list[str], lower: bool, keep_text: bool = False, hashed: bool = False) -> DataFrame:
    """One row per block. ``carry``: columns kept for each document; ``hashed``:
    the words' XXH64 of seed 1 take the place of the words."""

    def out(number: int, held: list[pa.RecordBatch], sizes: list[int], ids: list[np.ndarray], words: dict[bytes, int]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        if hashed:
            import xxhash

            kept, lengths = np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64).tobytes(), b""
        else:
            kept, lengths = b"".join(words), np.array([len(w) for w in words], "<u4").tobytes()
        row = {"block": number, "docs": len(sizes), "n_words": int(sum(sizes)), "rows": to_ipc(rows[0] if rows else held[0]),
               "sizes": np.array(sizes, "<u4").tobytes(), "ids": np.concatenate(ids).astype("<u4").tobytes() if ids else b"",
               "words": kept, "lengths": lengths}
        kinds = [pa.int64()] * 3 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        number = TaskContext.get().partitionId() << 32
        held, sizes, ids, words, size = [], [], [], numbering(), 0
        for b in text_slices(batches, "_text", BLOCK_BYTES // 4):
            raw = raw_texts(b.column("_text"))
            parts = [(x.lower() if lower else x).split() for x in raw]  # ASCII letters and white space
            own = list(map(len, parts))
            ids.append(np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.uint32, sum(own)))
            sizes += own
            held.append(b if keep_text else b.drop_columns(["_text"]))
            size += sum(map(len, raw))
            if size >= BLOCK_BYTES:
                yield out(number, held, sizes, ids, words)
                number += 1
                held, sizes, ids, words, size = [], [], [], numbering(), 0
                pa.default_memory_pool().release_unused()
        if held:
            yield out(number, held, sizes, ids, words)

    src = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)], F.col(text).cast("string").alias("_text"))
    return map_arrow(src, run, SCHEMA)


@contextlib.contextmanager
def bucketed(frame: DataFrame, name: str) -> Iterator[tuple[DataFrame, list[str]]]:
    """``frame`` written once as a table bucketed by ``block``, and a list for
    the paths of other tables that are only needed inside. The table lies in
    the shared checkpoint folder; all of them are deleted at the end."""
    spark = frame.sparkSession
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    # as many as the input's tasks ask for: a bucket's share does not grow with the input
    tasks = frame.rdd.getNumPartitions()
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, 2 * tasks))
    passing = [scratch_dir(spark, name)]
    frame.write.format("parquet").option("compression", "zstd").option("path", passing[0]).bucketBy(buckets, "block").saveAsTable(name)
    try:
        yield spark.table(name), passing
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in passing:
            delete(spark, path)


@contextlib.contextmanager
def block_table(docs: DataFrame, text: str, carry: list[str], lower: bool, keep_text: bool = False, hashed: bool = False) -> Iterator[tuple[DataFrame, int, list[str]]]:
    """The written table, the number of buckets for questions, and the list of
    ``bucketed``."""
    with bucketed(blocks(docs, text, carry, lower, keep_text, hashed), "word_blocks") as (own, passing):
        total = own.agg(F.sum("n_words")).first()[0] or 0
        yield own, max(1, -(-total // BUCKET_WORDS)), passing


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block({c: b.column(c)[k].as_py() for c in b.schema.names})


def cut(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, slice) of a sorted array of 64-bit hashes, by hash range."""
    edge = [-(-(k << 64) // buckets) for k in range(1, buckets)]
    at = [0, *np.searchsorted(sorted_hashes, np.array(edge, np.uint64)).tolist(), len(sorted_hashes)]
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


def ask(table: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(block)`` yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            yield from fn(b)

    return map_arrow(table, run, schema)


def answer(questions: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(table)`` answers the questions of one bucket."""
    ship_package(questions.sparkSession)
    return questions.groupBy("bucket").applyInArrow(fn, schema)


def with_answers(table: DataFrame, answers: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(block, answers as a pyarrow table)`` returns a pyarrow table. The
    blocks stay in their buckets; only answers are shuffled."""
    ship_package(table.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(Block({c: left.column(c)[0].as_py() for c in left.schema.names}), right)

    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
