"""Periodic runs inside documents, by seeds and extended diagonals.

A run is a longest stretch of words in which words one period apart are equal,
its period the smallest such, at least ``times`` periods and ``min_words`` words
long. On the diagonal of its period a run of n words matches itself over n -
period words, so every k-gram of that guaranteed overlap stands there and once
more a period later. Lags are taken in bands; a band's k is the overlap that its
smallest lag guarantees, and its k-grams are looked up among the positions whose
shorter k-grams repeat already.

Seeds are pairs of near occurrences of a k-gram in the same document. Two
occurrences nearer than k - lag + 2 would give the k-gram a second period that
divides the lag, so a run's own next occurrence is among the first few: seeds
stay linear in the words, however often a k-gram occurs. Seeds that follow each
other on a diagonal are one stretch; it is compared word by word, extended on
both sides, and a table per lag of the furthest word covered drops whatever lies
inside a former extension. Of stretches with equal ends the smallest lag is the
period.

Defined results: null, empty and white-space texts have no words and no runs;
repeated rows give repeated results; a document is one unit of work, however
long; ties of the leading run go to the smallest start, then period; null and
repeated ids are carried as they are; an empty table gives an empty result;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxomatch.llm.common import key_fields, keyed, map_arrow, raw_texts, resident, text_slices
from taxomatch.llm.recompress import ODD, mix
from taxomatch.llm.wordblocks import numbering

Run = tuple[int, int, int]  # start, length, period


def bands(min_words: int, times: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, end of lags, k): all lags up to ``longest``."""
    k = min(max(min_words - q, (times - 1) * q) for q in range(1, min_words + 2))
    lo, hi = 1, max(2, k * 3 // 4)
    while lo <= longest:
        yield lo, hi, k
        lo, hi, k = hi, max(hi + 1, hi * 3 // 2), max(k, 2 * hi)


class Grams:
    """Hashes of the k-grams of concatenated documents, by doubling."""

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            self.level = [mix(ids.astype(np.uint64) * ODD + np.uint64(1))]

    def _at(self, t: int) -> np.ndarray:
        while len(self.level) <= t:
            h, span = self.level[-1], 1 << (len(self.level) - 1)
            up = h.copy()
            if span < len(h):
                with np.errstate(over="ignore"):
                    up[:-span] = mix(h[:-span] * np.uint64(3) + h[span:] * ODD)
            self.level.append(up)
        return self.level[t]

    def of(self, at: np.ndarray, k: int) -> np.ndarray:
        t = k.bit_length() - 1
        h = self._at(t)
        with np.errstate(over="ignore"):
            return mix(h[at] * np.uint64(5) + h[at + (k - (1 << t))] * ODD)

    def only(self, mask: np.ndarray) -> None:
        self.level = [self.level[-1][mask] if n == len(self.level) - 1 else np.zeros(0, np.uint64) for n in range(len(self.level))]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key stands more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _seeds(key: np.ndarray, at: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of pairs of equal keys with a lag of the band, sorted by
    lag and position."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    near = (hi - 1) // max(1, k - hi + 2) + 1  # occurrences that may come up to the lag's own
    pos, lag = [], []
    for r in range(1, near + 1):
        q = at[r:] - at[:-r]
        good = (key[r:] == key[:-r]) & (q >= lo) & (q < hi)
        pos.append(at[:-r][good])
        lag.append(q[good])
    pos, lag = np.concatenate(pos), np.concatenate(lag)
    order = np.lexsort([pos, lag])
    return pos[order], lag[order]


def _reach(ids: np.ndarray, i: int, q: int, step: int) -> int:
    """How far from i, in the direction of step, words a lag q apart are equal."""
    n, size = 0, 16
    while True:
        if step > 0:
            a, b = ids[i + n:i + n + size], ids[i + q + n:i + q + n + size]
            a = a[:len(b)]
        else:
            lo = max(0, i - n - size + 1)
            a, b = ids[lo:i - n + 1][::-1], ids[lo + q:i - n + 1 + q][::-1]
        off = np.flatnonzero(a != b)
        if len(off):
            return n + int(off[0])
        n += len(a)
        if len(a) < size:
            return n
        size *= 2


def runs(ids: np.ndarray, sizes: np.ndarray, min_words: int = 24, times: int = 3) -> tuple[np.ndarray, list[Run]]:
    """(document, (start, length, period)) of every run of the documents whose
    words' numbers are concatenated in ``ids``, by document, start and period."""
    if times < 3 or min_words < times:
        raise ValueError("runs of at least three periods only")
    sizes = np.asarray(sizes, np.int64)
    docs = len(sizes)
    # a separator of its own after each document: nothing matches across it
    doc = np.repeat(np.arange(docs), sizes + 1)
    stop = np.cumsum(sizes + 1) - 1
    flat = np.empty(len(doc), np.int64)
    inner = np.ones(len(doc), bool)
    inner[stop] = False
    flat[inner] = ids
    flat[stop] = -1 - np.arange(docs)
    grams, found, at = Grams(flat), {}, None
    start, end = stop - sizes, stop
    for lo, hi, k in bands(min_words, times, int(sizes.max(initial=0)) // times):
        if at is None:
            at = np.flatnonzero(np.arange(len(flat)) + k <= end[doc])
        else:
            at = at[at + k <= end[doc[at]]]
        with np.errstate(over="ignore"):
            key = grams.of(at, k) ^ mix(doc[at].astype(np.uint64))
        again = _repeated(key)
        at, key = at[again], key[again]
        if not len(at):
            break
        if lo == 1:  # from here on, only documents with a repeated k-gram
            held = np.zeros(docs, bool)
            held[doc[at]] = True
            mask = held[doc]
            moved = np.cumsum(mask) - 1
            flat, doc, at = flat[mask], doc[mask], moved[at]
            start, end = np.where(held, moved[start], 0), np.where(held, moved[end], 0)
            grams.only(mask)
        pos, lag = _seeds(key, at, lo, hi, k)
        if not len(pos):
            continue
        first = np.ones(len(pos), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (pos[1:] != pos[:-1] + 1)
        head = np.flatnonzero(first)
        tail = np.append(head[1:], len(pos)) - 1
        span, q = pos[tail] - pos[head] + k, lag[head]
        long = span >= np.maximum(min_words - q, (times - 1) * q)
        covered: dict[int, int] = {}
        for i, n, q in zip(pos[head][long].tolist(), span[long].tolist(), q[long].tolist(), strict=True):
            if i < covered.get(q, 0) or (flat[i:i + n] != flat[i + q:i + q + n]).any():
                continue
            left, right = i - _reach(flat, i - 1, q, -1) if i else i, i + n + _reach(flat, i + n, q, 1)
            covered[q] = right
            found.setdefault((left, right + q), q)
    got = sorted((int(doc[a]), a - int(start[doc[a]]), b - a, q) for (a, b), q in found.items())
    return np.array([g[0] for g in got], np.int64), [g[1:] for g in got]


def _slice_runs(column: pa.Array, keys: list, rewrite: Callable | None, min_words: int, times: int) -> tuple[list[list[bytes]], list[list[Run]]]:
    """The words of each text and its runs."""
    words = [x.split() for x in raw_texts(column)]  # splits at x20 and x09 to x0D alone
    if rewrite is not None:
        words = [rewrite(key, w) for key, w in zip(keys, words, strict=True)]
    names, sizes = numbering(), np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(names.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    out: list[list[Run]] = [[] for _ in words]
    for d, run in zip(*runs(ids, sizes, min_words, times), strict=True):
        out[d].append(run)
    return words, out


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def leading(found: list[Run]) -> Run | None:
    """The run of the greatest exact length by period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _mapped(docs: DataFrame, key: str, text: str, min_words: int, times: int, rewrite: Callable | None, fields: str, out: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for b in text_slices(batches, "_text"):
            yield out(b.column(0), *_slice_runs(b.column("_text"), b.column(0).to_pylist() if rewrite else [], rewrite, min_words, times))

    src = docs.select(key, docs[text].cast("string").alias("_text"))
    return map_arrow(src, run, f"{key_fields(src, key)}, {fields}")


def find_runs(docs: DataFrame, min_words: int = 24, times: int = 3, key: str = "doc_id", text: str = "text", rewrite: Callable | None = None) -> DataFrame:
    """One row per run: (key, start, length, period), in words from 0."""

    def out(ids: pa.Array, words: list, found: list[list[Run]]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 3)
        return keyed({key: ids.take(pa.array(row)), "start": flat[:, 0], "length": flat[:, 1], "period": flat[:, 2]})

    return _mapped(docs, key, text, min_words, times, rewrite, "start long, length long, period long", out)


def collapse_runs(docs: DataFrame, min_words: int = 24, times: int = 3, key: str = "doc_id", text: str = "text", rewrite: Callable | None = None) -> DataFrame:
    """(key, text, n_removed) of every row: of each run its first period stays;
    words are joined by one space."""

    def out(ids: pa.Array, words: list[list[bytes]], found: list[list[Run]]) -> pa.RecordBatch:
        kept = [collapsed(w, f) for w, f in zip(words, found, strict=True)]
        return keyed({key: ids, "text": pa.array([b" ".join(k).decode() for k in kept], pa.string()),
                      "n_removed": pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64())})

    return _mapped(docs, key, text, min_words, times, rewrite, "text string, n_removed long", out)


def run_digests(docs: DataFrame, min_words: int = 24, times: int = 3, key: str = "doc_id", text: str = "text", rewrite: Callable | None = None) -> DataFrame:
    """Per row its runs' number, leading run and digests of all runs and of the
    collapsed text. ``rewrite(key, words)`` may change a document's words first."""

    def out(ids: pa.Array, words: list[list[bytes]], found: list[list[Run]]) -> pa.RecordBatch:
        lead = [leading(f) for f in found]
        told = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in f).encode()).hexdigest() for f in found]
        kept = [hashlib.sha256(b" ".join(collapsed(w, f))).hexdigest() for w, f in zip(words, found, strict=True)]
        part = {n: pa.array([r and r[k] for r in lead], pa.int64()) for k, n in enumerate(("start", "length", "period"))}
        return keyed({key: ids, "n_runs": pa.array([len(f) for f in found], pa.int64()), **part,
                      "exponent_milli": pa.array([r and 1000 * r[1] // r[2] for r in lead], pa.int64()), "runs_sha256": told, "collapsed_sha256": kept})

    return _mapped(docs, key, text, min_words, times, rewrite,
                   "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", out)
