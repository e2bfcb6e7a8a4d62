"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks whose borders depend
on the bytes around them alone, so passages shared by documents give the same
chunks wherever they stand. A distinct chunk is encoded once per task and taken
from the table afterwards. A chunk keeps the ids of the words that lie wholly
inside it; the piece before its first and after its last white space belongs to
a join. At every join the straddling word is re-encoded, growing over chunks
without white space until both sides agree on a word border: from there on the
ids equal those of the whole text, because no token crosses white space.

Decoding follows the file: without a decoder the tokens are joined by spaces.

Defined results: null and empty texts give no ids and an empty decoded text;
repeated rows give repeated results; an empty table an empty result; texts of
any length are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxomatch.llm.common import key_fields, keyed, map_arrow, raw_texts, resident, text_slices
from taxomatch.llm.wordids import WordIds

WINDOW = 16  # bytes that a border depends on
MASK = 127  # one border in 128 bytes
CHUNKS = 80_000  # table size


def borders(buf: np.ndarray) -> np.ndarray:
    """Positions where a chunk ends: the rolling hash of the last WINDOW bytes
    has its seven top bits clear."""
    if not len(buf):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = np.arange(256, dtype=np.uint32) * np.uint32(2654435761) + np.uint32(0x9E3779B9)
        mixed ^= mixed >> np.uint32(15)
        step = mixed[buf]
        h, span = step, 1
        while span < WINDOW:  # windows of 1, 2, 4, ... bytes
            far = np.zeros_like(h)
            far[span:] = h[:-span] if span < len(h) else 0
            h = h + far * np.uint32(pow(0x01000193, span, 1 << 32))
            span *= 2
    return np.flatnonzero((h >> np.uint32(25)) & np.uint32(MASK) == 0) + 1


class Chunk:
    __slots__ = ("head", "words", "tail", "ids", "text")

    def __init__(self, raw: bytes):
        words = raw.split()
        self.head = words.pop(0) if words and not raw[:1].isspace() else b""
        self.tail = words.pop() if words and not raw[-1:].isspace() else b""
        self.words, self.ids, self.text = words, b"", b""


class ChunkCodec:
    def __init__(self, path: str):
        self.words = WordIds(path, 200_000, shown=True)
        if self.words.tok.decoder is not None:
            raise ValueError("only files without a decoder are supported")
        self.chunks: dict[bytes, Chunk | None] = {}

    def encode(self, raws: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as bytes, decoded text) of each text."""
        self.words.trim()
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        buf = b"".join(raws)
        cut = borders(np.frombuffer(buf, np.uint8))
        plans, need, fresh, start = [], set(), [], 0
        for raw in raws:
            end = start + len(raw)
            inner = cut[np.searchsorted(cut, start, "right"):np.searchsorted(cut, end, "left")].tolist()
            plan, pending, lo = [], b"", start
            for hi in [*inner, end]:
                piece = buf[lo:hi]
                lo = hi
                got = self.chunks.get(piece, 0)
                if got == 0:
                    got = Chunk(piece) if len(piece.split(None, 1)) > 1 or piece[:1].isspace() or piece[-1:].isspace() else None
                    self.chunks[piece] = got
                    if got is not None:
                        fresh.append(got)
                        need.update(got.words)
                if got is None:
                    pending += piece  # no white space yet: the join goes on
                    continue
                word = pending + got.head
                if word:
                    plan.append(word)
                    need.add(word)
                plan.append(got)
                pending = got.tail
            if pending:
                plan.append(pending)
                need.add(pending)
            plans.append(plan)
            start = end
        self.words.learn(need)
        known = self.words.ids
        for c in fresh:
            got = [known[w] for w in c.words]
            c.ids = b"".join([x[0] for x in got])
            c.text = b" ".join([x[1] for x in got if x[1]])
            c.words = ()
        for plan in plans:
            got = [known[x] if type(x) is bytes else (x.ids, x.text) for x in plan]
            yield b"".join([x[0] for x in got]), b" ".join([x[1] for x in got if x[1]])


def _encoded(docs: DataFrame, path: str, key: str, text: str, fields: dict, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = resident(("codec", path), lambda: ChunkCodec(path))
        for b in text_slices(batches, "_text"):
            rows = [row(*x) for x in c.encode(raw_texts(b.column("_text")))]
            yield keyed({key: b.column(0), **{f: pa.array([r[k] for r in rows], t) for k, (f, (t, _)) in enumerate(fields.items())}})

    src = docs.select(key, docs[text].cast("string").alias("_text"))
    return map_arrow(src, run, ", ".join([key_fields(src, key), *(f"{f} {s}" for f, (_, s) in fields.items())]))


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<long>, decoded string) of every row."""
    return _encoded(docs, path, key, text, {"ids": (pa.list_(pa.int64()), "array<long>"), "decoded": (pa.string(), "string")},
                    lambda ids, text: (np.frombuffer(ids, "<u4").astype(np.int64), text.decode()))


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, without
    moving the ids out of the tasks."""
    return _encoded(docs, path, key, text,
                    {"n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")},
                    lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
