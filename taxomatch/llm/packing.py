"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A task gathers documents into a shard of at most ``shard_tokens`` tokens (one
very long document may exceed it). Whole sequence lengths of a long document
become sequences of their own; what remains of each document is packed: the
shard opens just enough sequences for all its tokens, documents go in
descending order of length, each to the sequence of lowest cost that has room,
where a piece of n tokens costs n + quadratic * n * n (the linear part and the
attention). A document for which no sequence has room is cut over the largest
rooms, so a shard pads less than one sequence. Shards need no shuffle and a
lost task is simply run again.

Defined results: a null or empty text is the end id alone; equal lengths are
taken in input order; repeated rows are packed as often as they come; an empty
table gives no sequence; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from taxomatch.llm.common import key_fields, keyed, map_arrow, raw_texts, resident, text_slices
from taxomatch.llm.wordids import WordIds

QUADRATIC = 1 / 4096  # cost of attention against the linear part, per token
SHARD_TOKENS = 4 << 20
WORDS = 700_000  # words of which a task keeps the ids, per generation


def plan_pieces(lengths: list[int], room: int, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences
    are numbered from 0."""
    pieces, full = [], 0
    rest = np.zeros(len(lengths), np.int64)
    for d, n in enumerate(lengths):
        for k in range(n // room):
            pieces.append((d, k * room, room, full, 0))
            full += 1
        rest[d] = n % room
    if not rest.any():
        return pieces
    k = -(-int(rest.sum()) // room)
    free = np.full(k, room, np.int64)
    cost = np.zeros(k)
    later = []

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, full + s, int(room - free[s])))
        free[s] -= n
        cost[s] += n + quadratic * n * n

    for d in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[d])
        if n == 0:
            break
        s = int(np.argmin(np.where(free >= n, cost, np.inf)))
        if free[s] >= n:
            put(d, lengths[d] - n, n, s)
        else:
            later.append(d)
    for d in later:
        start = lengths[d] - int(rest[d])
        while start < lengths[d]:
            s = int(np.argmax(free))
            n = min(int(free[s]), lengths[d] - start)
            put(d, start, n, s)
            start += n
    return pieces


def encode_documents(batch: pa.RecordBatch, words: WordIds, end_id: int) -> list[bytes]:
    """The ids of each text and the end id, as bytes."""
    words.trim()
    raw = raw_texts(batch.column("_text"))
    parts = [x.split() for x in raw]
    ids = words.of([w for x in parts for w in x])
    end = np.array([end_id], "<u4").tobytes()
    at = [0, *accumulate(map(len, parts))]
    return [b"".join(ids[a:b]) + end for a, b in pairwise(at)]


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text",
         quadratic: float = QUADRATIC, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, unless left out, the ids."""

    def shard(keys: list[pa.Array], held: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        sizes = [len(x) // 4 for x in held]
        plan = plan_pieces(sizes, length, quadratic)
        cut = [held[d][4 * s:4 * (s + n)] for d, s, n, _, _ in plan]
        d, s, n, q, o = (np.array(x, np.int64) for x in zip(*plan, strict=True))
        out = {key: pa.concat_arrays(keys).take(pa.array(d)), "start": s, "length": n,
               "ids_crc32": pa.array(map(zlib.crc32, cut), pa.int64()), "doc_tokens": np.array(sizes, np.int64)[d],
               "sequence_id": q + first, "offset": o}
        if with_ids:
            out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32()))
        return keyed(out), int(q.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = resident(("packing", path), lambda: WordIds(path, WORDS))
        keys, held, tokens = [], [], 0
        next_id = TaskContext.get().partitionId() << 36
        for b in text_slices(batches, "_text"):
            ids = encode_documents(b, words, end_id)
            keys.append(b.column(0))
            held += ids
            tokens += sum(map(len, ids)) // 4
            if tokens >= shard_tokens:
                out, n = shard(keys, held, next_id)
                yield out
                next_id += n
                keys, held, tokens = [], [], 0
        if held:
            yield shard(keys, held, next_id)[0]

    src = docs.select(key, docs[text].cast("string").alias("_text"))
    return map_arrow(src, run, f"{key_fields(src, key)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
                     + ", ids array<int>" * with_ids)
