"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a linked list; a heap holds every adjacent pair that
has a merge rank, lowest rank first and leftmost among equals. Each pop merges
one pair and pushes the two pairs it makes. The count is the number of initial
symbols minus the number of merges; no identifier is ever emitted. A word's
count depends on the word alone, so a task counts each distinct word once.

Defined results: null and empty texts count 0 tokens and 0 bytes; repeated
rows give repeated results; an empty table gives an empty result; texts of any
length are counted whole; a special string inside a text counts one token.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from taxomatch.llm.common import key_fields, keyed, map_arrow, raw_texts, resident, text_slices

#: Fixed value: the byte-level pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of a byte-level BPE file (``tokenizers`` JSON)."""

    def __init__(self, path: str, limit: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.byte = [vocab[c] for c in byte_symbols()]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {(a << 32) | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.special_list = special
        self.find = regex.compile(PATTERN).findall
        self.limit = limit
        self.known: dict[str, int] = {}

    def merge_count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(word)
        if n < 2:
            return n
        byte, rank, left, right, made = self.byte, self.rank, self.left, self.right, self.made
        sym = [byte[b] for b in word]
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] << 32 | sym[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        merges = 0
        while heap:
            top = pop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] != left[r] or sym[j] != right[r]:
                continue  # one of the two symbols has been merged meanwhile
            sym[i], sym[j] = made[r], -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                q = rank.get(sym[i] << 32 | sym[k])
                if q is not None:
                    push(heap, q << 32 | i)
            h = before[i]
            if h >= 0:
                q = rank.get(sym[h] << 32 | sym[i])
                if q is not None:
                    push(heap, q << 32 | h)
        return n - merges

    def count_all(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.limit:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            pieces, total = [text], 0
            if self.special is not None and any(s in text for s in self.special_list):
                pieces = self.special.split(text)
                total = len(pieces) - 1
            for piece in pieces:
                words = self.find(piece)
                for w in set(words).difference(known):
                    known[w] = self.merge_count(w.encode())
                total += sum(map(known.__getitem__, words))
            out.append(total)
        return out


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = resident(("counts", path), lambda: MergeCounter(path))
        for b in text_slices(batches, "_text"):
            raw = raw_texts(b.column("_text"))
            n = c.count_all([x.decode() for x in raw])
            yield keyed({key: b.column(0), "n_bytes": pa.array(map(len, raw), pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                         "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    src = docs.select(key, docs[text].cast("string").alias("_text"))
    return map_arrow(src, run, f"{key_fields(src, key)}, n_bytes long, n_tokens long, over_limit boolean")
