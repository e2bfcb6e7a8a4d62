"""Alignment of two tokenizers' tokens, by divide and conquer at shared cuts.

Both tokenizers' tokens cover the same bytes: a space and the text. Between two
neighbouring shared cuts (byte offsets where tokens of both end) lies a group.
``shared_cuts`` finds them: it takes the end near the middle of an interval of
A's tokens, looks by bisection whether a token of B ends there too, goes on with
the ends beside it until one is shared, and treats the two halves alike; an
interval without a shared end inside is a leaf, one group. All open intervals
take each step together. Inside a group the links, that is the pairs of
overlapping tokens, number its tokens less one.

A text is first divided where a cut is certain: before a single space between
two visible characters both tokenizers start anew, because neither has a token
with a space after another character. Each distinct stretch between such spaces
of a block of documents, whatever its length, is tokenised and aligned once.

How many documents hold a pair linked is counted in two steps: a task writes its
documents as blocks (stretch numbers, and each distinct pair once with the
number of documents), Spark sums the pairs, and each block gets the sums of its
pairs back. No pair comes more than once per block, so no key is hot.

Defined results: null and empty texts, and texts whose tokens' bytes are not the
space and the text, have no tokens and zeros; white space alone is a text;
special strings inside texts are plain text; repeated rows are documents of
their own, in results and counts; null and repeated ids are carried as they are;
of tied highest counts all count as best; texts of any length are aligned
whole; an empty table gives an empty result; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxomatch.llm.bpe_count import byte_symbols
from taxomatch.llm.common import key_fields, keyed, map_arrow, resident, saved, text_slices, texts
from taxomatch.llm.wordblocks import bucketed, from_ipc, numbering, to_ipc
from taxomatch.session import ship_package

CUT = re.compile(r"(?<=\S) (?=\S)")
BLOCK_BYTES = 8 << 20
LINE = 64  # stretches that are sent to a tokenizer in one text
PAIR = 32  # bits of B's id in a pair


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B) up to each shared cut, the last one included.
    Both arrays are the tokens' ends in ascending order, with the same last."""
    found_a, found_b = [np.array([len(ends_a)])], [np.array([len(ends_b)])]
    a, a_end, b, b_end = (np.array([x]) for x in (0, len(ends_a), 0, len(ends_b)))
    while len(a):
        i, j = _near_middle(ends_a, ends_b, a, a_end - 1, b, b_end - 1)
        cut = i >= 0
        a, a_end, b, b_end, i, j = (x[cut] for x in (a, a_end, b, b_end, i + 1, j + 1))
        found_a.append(i)
        found_b.append(j)
        a, a_end, b, b_end = (np.concatenate(x) for x in ((a, i), (i, a_end), (b, j), (j, b_end)))
        open_ = (a_end - a > 1) & (b_end - b > 1)
        a, a_end, b, b_end = a[open_], a_end[open_], b[open_], b_end[open_]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _near_middle(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the shared end nearest to the middle of A's ends from a
    to a_end, as places in both arrays; -1 where there is none."""
    out_a, out_b = np.full(len(a), -1), np.full(len(a), -1)
    middle, todo, away = (a + a_end) // 2, np.flatnonzero((a < a_end) & (b < b_end)), 0
    while len(todo):
        for side in (-1, 1) if away else (1,):
            i = middle[todo] + side * away
            inside = (i >= a[todo]) & (i < a_end[todo])
            k, i = todo[inside], i[inside]
            j = np.searchsorted(ends_b, ends_a[i])
            hit = (j < b_end[k]) & (ends_b[np.minimum(j, len(ends_b) - 1)] == ends_a[i])
            out_a[k[hit]], out_b[k[hit]] = i[hit], j[hit]
            todo = todo[out_a[todo] < 0]
        away += 1
        todo = todo[(middle[todo] - away >= a[todo]) | (middle[todo] + away < a_end[todo])]
    return out_a, out_b


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B) of all links, by A; and the links of each token of A."""
    first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), "right")
    many = np.searchsorted(ends_b, ends_a) - first + 1
    return np.repeat(np.arange(len(ends_a)), many), ranges(first, many), many


class Tokenizers:
    """A is a byte-level file of ``tokenizers``, B a model of ``sentencepiece``
    that puts a space in front of a text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte = {c: k for k, c in enumerate(byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for _, p in pieces):
            raise ValueError(f"{path_b} has pieces with a space after another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # ids as digits, with what stands behind them: inside and at the end of a group
        self.shown = [*(f"{i}," for i in range(len(self.bytes_a))), *(f"{i}|" for i in range(len(self.bytes_a))),
                      *(f"{i}," for i in range(len(self.bytes_b))), *(f"{i};" for i in range(len(self.bytes_b)))]

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each stretch's tokens are its bytes, all ids of A, of B); the
        ids are those of the good stretches, one after the other."""
        good = np.array(["▁" not in s for s in stretches], bool)  # that mark and a space are one to B
        lines: list[list[int]] = [[]]
        for k in np.flatnonzero(good).tolist():
            s = stretches[k]
            if s[0].isspace() or s[-1].isspace():  # a text's own end: a space beside it would not be a certain cut
                lines += [[k], []]
                continue
            if len(lines[-1]) == LINE:
                lines.append([])
            lines[-1].append(k)
        lines = [line for line in lines if line]
        ids_a, ids_b = [], []
        for line, x, y, same in self._lines(lines, stretches):
            if same:
                ids_a.append(x)
                ids_b.append(y)
                continue
            for [k], x, y, same in self._lines([[k] for k in line], stretches):
                good[k] = same
                if same:
                    ids_a.append(x)
                    ids_b.append(y)
        return good, *(np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (ids_a, ids_b))

    def _lines(self, lines: list[list[int]], stretches: list[str]) -> Iterator[tuple[list[int], list[int], list[int], bool]]:
        for lo in range(0, len(lines), 256):
            part = lines[lo:lo + 256]
            text = [" ".join([stretches[k] for k in line]) for line in part]
            for line, t, x, y in zip(part, text, self.a.encode_batch_fast([" " + t for t in text], add_special_tokens=False), self.b.encode(text, num_threads=1), strict=True):
                raw, x = b" " + t.encode(), x.ids
                yield line, x, y, b"".join(map(self.bytes_a.__getitem__, x)) == raw == b"".join(map(self.bytes_b.__getitem__, y))


def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return resident(("align", path_a, path_b), lambda: Tokenizers(path_a, path_b))


class Aligned:
    """The texts of a slice: their valid documents' stretch numbers, and what
    there is of each distinct stretch. ``a_cut``, ``b_cut``: tokens up to the end
    of each group; ``u_*``: tokens, groups and links up to the end of each stretch."""

    def __init__(self, tok: Tokenizers, column: pa.Array):
        parts = [CUT.split(t) if t else [] for t in texts(column)]
        names = numbering()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        unit = np.fromiter(map(names.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        good, self.a, self.b = tok.encode(list(names))
        valid = np.ones(len(parts), bool)
        doc = np.repeat(np.arange(len(parts)), sizes)
        valid[doc[~good[unit]]] = False
        self.sizes, keep = np.where(valid, sizes, 0), valid[doc]
        self.doc = doc[keep]
        self.unit = (np.cumsum(good) - 1)[unit[keep]]  # among the good ones
        size = np.fromiter((len(s.encode()) + 1 for s, g in zip(names, good.tolist(), strict=True) if g), np.int64, int(good.sum()))
        self.n_units, self.tok = len(size), tok
        self.ends_a, self.ends_b = np.cumsum(tok.size_a[self.a]), np.cumsum(tok.size_b[self.b])
        self.a_cut, self.b_cut = shared_cuts(self.ends_a, self.ends_b) if len(size) else (np.zeros(0, np.int64),) * 2
        border = np.cumsum(size)
        self.u_a, self.u_b = np.searchsorted(self.ends_a, border) + 1, np.searchsorted(self.ends_b, border) + 1
        self.u_groups = np.searchsorted(self.a_cut, self.u_a) + 1
        at_a, at_b, many = overlaps(self.ends_a, self.ends_b) if len(size) else (np.zeros(0, np.int64),) * 3
        self.pairs = self.a[at_a] << PAIR | self.b[at_b]
        self.u_pairs = np.cumsum(many)[self.u_a - 1]

    def summed(self, upto: np.ndarray) -> np.ndarray:
        """The sum over a document's stretches."""
        return sums(np.diff(upto, prepend=0)[self.unit], self.sizes)

    def shown(self) -> list[str]:
        """Each stretch's groups as text, with a semicolon at the end."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.a_cut - 1], last_b[self.b_cut - 1] = 1, 1
        n_a, n_b = np.diff(self.a_cut, prepend=0), np.diff(self.b_cut, prepend=0)
        place = np.cumsum(n_a + n_b) - n_a - n_b  # of each group among all tokens
        kind = np.empty(len(self.a) + len(self.b), np.int64)
        kind[ranges(place, n_a)] = self.a + last_a * len(self.tok.bytes_a)
        kind[ranges(place + n_a, n_b)] = self.b + last_b * len(self.tok.bytes_b) + 2 * len(self.tok.bytes_a)
        piece = list(map(self.tok.shown.__getitem__, kind.tolist()))
        end = (self.u_a + self.u_b).tolist()
        return ["".join(piece[lo:hi]) for lo, hi in zip([0, *end[:-1]], end, strict=True)]


def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto, end = np.concatenate([np.zeros(1, np.int64), np.cumsum(x)]), np.cumsum(sizes)
    return upto[end] - upto[end - sizes]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the next range."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


BLOCK = ("block long, rows binary, n_a binary, n_b binary, n_groups binary, sha binary, sizes binary, units binary, unit_pairs binary, at binary, "
         "pairs array<long>, docs array<long>")
FIELDS = [pa.field("block", pa.int64()), *[pa.field(n, pa.binary()) for n in ("rows", "n_a", "n_b", "n_groups", "sha", "sizes", "units", "unit_pairs", "at")],
          pa.field("pairs", pa.list_(pa.int64())), pa.field("docs", pa.list_(pa.int64()))]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _block(number: int, rows: pa.RecordBatch, t: Aligned) -> pa.RecordBatch:
    """A row of the block table. ``at``: places among the distinct pairs of the
    pairs of each distinct stretch; ``docs``: documents that hold each pair."""
    pairs = _distinct(t.pairs)
    at = np.searchsorted(pairs, t.pairs)
    n_pairs = np.diff(t.u_pairs, prepend=0)
    used = _distinct(t.doc * max(1, t.n_units) + t.unit)  # stretches of each document, once
    doc, unit = used // max(1, t.n_units), used % max(1, t.n_units)
    held = at[ranges((t.u_pairs - n_pairs)[unit], n_pairs[unit])]
    once = _distinct(np.repeat(doc, n_pairs[unit]) * max(1, len(pairs)) + held) % max(1, len(pairs))
    shown, ends = list(map(t.shown().__getitem__, t.unit.tolist())), np.cumsum(t.sizes).tolist()
    sha = b"".join(hashlib.sha256("".join(shown[hi - n:hi])[:-1].encode()).digest() if n else bytes(32) for hi, n in zip(ends, t.sizes.tolist(), strict=True))
    pack = lambda x, kind="<i8": np.asarray(x).astype(kind).tobytes()
    row = [number, to_ipc(rows), pack(t.summed(t.u_a)), pack(t.summed(t.u_b)), pack(t.summed(t.u_groups)),
           sha, pack(t.sizes, "<u4"), pack(t.unit, "<u4"), pack(n_pairs, "<u4"), pack(at, "<u4"), pairs, np.bincount(once, minlength=len(pairs)).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FIELDS, strict=True)], names=[f.name for f in FIELDS])


def _blocks(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in text_slices(batches, "_text", BLOCK_BYTES):
            yield _block(number, b.select(["_key"]), Aligned(_tokenizers(path_a, path_b), b.column("_text")))
            number += 1

    return map_arrow(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")), run, BLOCK)


def _pair_rows(blocks: DataFrame) -> DataFrame:
    pair = F.posexplode(F.arrays_zip("pairs", "docs"))
    return blocks.select(F.col("block").alias("asks"), pair.alias("at", "x")).select("asks", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))


def _counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the pair, and whether no other pair
    of its A id is held by more. A's vocabulary bounds the number of groups of
    the second step, B's their size."""
    n = _pair_rows(blocks).groupBy("pair").agg(F.sum("docs").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", PAIR)))
    return n.select("pair", "n", (F.col("n") == highest).alias("best"))




def pair_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, n_docs, best) of every pair of ids linked in some document."""
    counts = _counts(_blocks(docs, path_a, path_b, key, text))
    return counts.select(F.shiftright("pair", PAIR).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << PAIR) - 1).cast("int").alias("b"),
                         F.col("n").alias("n_docs"), "best")


def _lists(ids: np.ndarray, start: np.ndarray, size: np.ndarray, g: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[g])]), pa.int32()), pa.array(ids[ranges(start[g], size[g])], pa.int32()))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups) of every row; a group is its first byte and end in the space
    and the text, and the ids of both tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "_text"):
            t = Aligned(_tokenizers(path_a, path_b), b.column("_text"))
            n_groups = np.diff(t.u_groups, prepend=0)[t.unit]
            g = ranges(t.u_groups[t.unit] - n_groups, n_groups)  # groups of all documents, in order
            end = np.cumsum(np.diff(t.ends_a[t.a_cut - 1], prepend=0)[g])
            many = sums(n_groups, t.sizes)
            ends = end - np.repeat(np.concatenate([[0], end])[np.cumsum(many) - many], many)
            start = ends - np.diff(end, prepend=0)
            ids = [_lists(x, cut - np.diff(cut, prepend=0), np.diff(cut, prepend=0), g) for x, cut in ((t.a, t.a_cut), (t.b, t.b_cut))]
            group = pa.StructArray.from_arrays([pa.array(start), pa.array(ends), *ids], names=["start", "end", "a", "b"])
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), group)
            yield keyed({key: b.column(0), "groups": out})

    src = docs.select(key, docs[text].cast("string").alias("_text"))
    return map_arrow(src, run, f"{key_fields(src, key)}, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>")


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of
    every row: the links whose pair is the most frequent of its A id, and the
    sum of the links' document counts."""
    kind = key_fields(docs, key)

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.schema.names}
        read = lambda c, k="<i8": np.frombuffer(row[c], k).astype(np.int64)
        n_a, n_b, n_groups, sizes, units, n_pairs, at = read("n_a"), read("n_b"), read("n_groups"), *(read(c, "<u4") for c in ("sizes", "units", "unit_pairs", "at"))
        order = right.column("at").to_numpy()
        n, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        n[order], best[order] = right.column("n").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        sha = [row["sha"][k:k + 32].hex() if s else "" for k, s in zip(range(0, 32 * len(sizes), 32), sizes.tolist(), strict=True)]
        return pa.table({key: from_ipc(row["rows"]).column(0), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
                         "n_best": sums(sums(best[at], n_pairs)[units], sizes), "count_sum": sums(sums(n[at], n_pairs)[units], sizes),
                         "groups_sha256": pa.array(sha, pa.string())})

    with bucketed(_blocks(docs, path_a, path_b, key, text), "aligned") as (table, passing):
        counts = saved(_counts(table), "pair-counts", passing)
        answers = _pair_rows(table).join(counts, "pair").select("asks", F.col("at").cast("long").alias("at"), "n", "best")
        ship_package(docs.sparkSession)
        held = table.drop("pairs", "docs").groupBy("block").cogroup(answers.groupBy("asks"))
        schema = f"{kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return saved(held.applyInArrow(told, schema), "alignment")
