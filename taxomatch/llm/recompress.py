"""Substring deduplication by recompression.

Each round first names maximal runs of one symbol, then pairs of a left-class
symbol followed by a right-class one; a symbol's class is a bit of its name.
Names are hashes of what they stand for, so every task gives the same name to
the same run or pair without a dictionary, and whether two neighbours merge
depends on them alone. Equal substrings therefore get equal symbols except for
a few at their ends, and which ones may differ is known: a window's certain
symbols are those between the ends that a round could have changed.

A bucket of a range of names tells which top-level symbols stand at more than
one place. A window with a certain symbol that stands nowhere else is unique.
The others are verified by a 128-bit hash of their words, again answered by
buckets. A window too short or too uniform to have a certain symbol is verified
as well, so the symbols decide nothing but how much is verified.

Defined results: null, empty and white-space texts have no words; a document of
fewer words than a window keeps all; repeated rows repeat each other's windows;
an empty table gives an empty result; a text of any length is one document of
its block; names of other columns cannot clash with inner ones. Rows keep their number and their id,
null or repeated; other columns are carried only if asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import key_fields, saved
from taxomatch.llm.wordblocks import Block, answer, ask, block_table, cut, with_answers

ROUNDS = 4
ODD = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parse(names: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(top-level names, first, end): the certain symbols of the window that
    starts at word i are first[i] up to end[i]. doc: the words' documents."""
    n = len(names)
    first, end = np.arange(n), np.minimum(np.arange(n) + window, n)
    with np.errstate(over="ignore"):
        for r in range(rounds):
            # runs: the one at either end may go on outside the window
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            times = np.diff(start, append=len(names)).astype(np.uint64)
            first, end = _move(run, 1, first, len(start)), np.where(end > 0, run[end - 1], 0)
            names, doc = names[start], doc[start]
            names = np.where(times > 1, mix(names * ODD + times * np.uint64(0xD6E8FEB86659FD93)), names)
            # pairs: a right symbol at the start and a left one at the end may be taken from outside
            left = (mix(names + np.uint64(r + 1) * ODD) >> np.uint64(63)).astype(bool)
            joined = np.zeros(len(names), bool)
            joined[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
            pair = np.cumsum(~joined) - 1
            first = _move(pair + ~left, 0, first, int(pair[-1]) + 1)
            end = np.where(end > 0, (pair + ~left)[end - 1], 0)
            start = np.flatnonzero(~joined)
            second = np.minimum(start + 1, len(names) - 1)
            both = joined[second] & (second > start)
            names, doc = np.where(both, mix(mix(names[start]) * np.uint64(3) + names[second] * ODD), names[start]), doc[start]
    return names, first, end


def _move(to: np.ndarray, plus: int, at: np.ndarray, past: int) -> np.ndarray:
    """``to[at] + plus``, where positions past the last stay past it."""
    return np.where(at < len(to), to[np.minimum(at, len(to) - 1)] + plus, past)


def window_hashes(h: np.ndarray, start: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomial hashes, mixed, of the windows of words that begin at start."""
    with np.errstate(over="ignore"):
        power, back = np.full((2, len(h) + 1), 1, np.uint64)
        power[1:], back[1:] = base, pow(base, -1, 1 << 64)
        power, back = np.cumprod(power), np.cumprod(back)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
        return mix((upto[start + window] - upto[start]) * back[start])


def _parsed(b: Block, window: int, rounds: int):
    doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
    return parse(b.hashes(1)[b.ids], doc, window, rounds) if len(b.ids) else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)


def _question(block: int, hashes: np.ndarray, many: np.ndarray, buckets: int, more: np.ndarray | None = None) -> pa.RecordBatch:
    parts = cut(hashes, buckets)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()),
         *[pa.array([x[s].tobytes() if x is not None else None for _, s in parts], pa.binary()) for x in (hashes, more, many)]],
        names=["bucket", "block", "hashes", "more", "many"])


QUESTION = "bucket int, block long, hashes binary, more binary, many binary"
ANSWER = "bucket int, block long, shared binary"


def _shared(group: pa.Table) -> pa.Table:
    """For each question a bit per hash: whether it stands at two places."""
    hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    more = [np.frombuffer(x, np.uint64) if x is not None else None for x in group.column("more").to_pylist()]
    many = np.concatenate([np.frombuffer(x, bool) for x in group.column("many").to_pylist()])
    flat = np.concatenate(hashes)
    key = [flat] if more[0] is None else [np.concatenate(more), flat]
    order = np.lexsort(key)
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in key:
        new[1:] |= k[order][1:] != k[order][:-1]
    kind = np.cumsum(new) - 1
    total = np.bincount(kind, weights=1.0 + many[order])
    shared = np.empty(len(order), bool)
    shared[order] = total[kind] > 1
    ends = np.cumsum([len(h) for h in hashes])
    bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table({"bucket": group.column("bucket"), "block": group.column("block"), "shared": pa.array(bits, pa.binary())})


def _told(answers: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The answers' bits in the order of the sorted hashes."""
    out = np.zeros(len(hashes), bool)
    bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist(), strict=True))
    for k, s in cut(hashes, buckets):
        out[s] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=s.stop - s.start).astype(bool)
    return out


def _pairs_sorted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of first appearances, class of each, size of each class) of pairs."""
    order = np.lexsort([b, a])
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind, np.bincount(kind, minlength=int(new.sum()))


def _windows(b: Block, window: int, candidate: np.ndarray):
    start = np.flatnonzero(candidate)
    one = window_hashes(b.hashes(1)[b.ids], start, window, 0x5851F42D4C957F2D)
    two = window_hashes(b.hashes(2)[b.ids], start, window, 0x2545F4914F6CDD1D)
    return start, one, two


def _marked(table: DataFrame, buckets: int, passing: list[str], window: int, rounds: int, out, schema: str) -> DataFrame:
    """``out(block, removed)``: removed holds a flag for each word."""

    def symbols(b: Block) -> Iterator[pa.RecordBatch]:
        names = _parsed(b, window, rounds)[0]
        if len(names):
            names, times = np.unique(names, return_counts=True)
            yield _question(b.block, names, times > 1, buckets)

    def verify(b: Block, answers: pa.Table) -> pa.Table:
        names, first, end = _parsed(b, window, rounds)
        known = np.unique(names)
        lone = ~_told(answers, known, buckets)[np.searchsorted(known, names)]
        upto = np.concatenate([[0], np.cumsum(lone)])
        starts = np.arange(len(b.ids))
        room = starts + window <= np.repeat(b.ends, b.sizes)
        certain = upto[np.maximum(end, np.minimum(first, len(names)))] - upto[np.minimum(first, len(names))]
        candidate = room & (certain == 0)
        parts = [_note(b.block, candidate)]
        if candidate.any():
            _, one, two = _windows(b, window, candidate)
            place, _, times = _pairs_sorted(one, two)
            parts.append(_question(b.block, one[place], times > 1, buckets, two[place]))
        return pa.Table.from_batches(parts)

    def _note(block: int, candidate: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([block], pa.int64()), pa.array([np.packbits(candidate).tobytes()], pa.binary()),
             pa.array([None], pa.binary()), pa.array([None], pa.binary())], names=["bucket", "block", "hashes", "more", "many"])

    def remove(b: Block, answers: pa.Table) -> pa.Table:
        removed = np.zeros(len(b.ids), bool)
        notes = [x for k, x in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist(), strict=True) if k < 0]
        if len(b.ids) and notes:
            candidate = np.unpackbits(np.frombuffer(notes[0], np.uint8), count=len(b.ids)).astype(bool)
            start, one, two = _windows(b, window, candidate)
            if len(start):
                place, kind, _ = _pairs_sorted(one, two)
                dup = start[_told(answers, one[place], buckets)[kind]]
                step = np.zeros(len(b.ids) + 1, np.int64)
                np.add.at(step, dup, 1)
                np.add.at(step, dup + window, -1)
                removed = np.cumsum(step)[:-1] > 0
        return out(b, removed)

    shared = answer(ask(table, symbols, QUESTION), _shared, ANSWER)
    second = saved(with_answers(table, shared, verify, QUESTION), "window-questions", passing)
    notes = second.where("bucket < 0").selectExpr("bucket", "block", "hashes as shared")
    return with_answers(table, answer(second.where("bucket >= 0"), _shared, ANSWER).unionAll(notes), remove, schema)


def _per_document(b: Block, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    upto = np.concatenate([[0], np.cumsum(removed)])
    return b.sizes, upto[b.ends] - upto[b.ends - b.sizes]


def removal_digests(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row."""

    def out(b: Block, removed: np.ndarray) -> pa.Table:
        sizes, gone = _per_document(b, removed)
        words, ids = b.words, b.ids
        sha = []
        for lo, hi, g in zip((b.ends - b.sizes).tolist(), b.ends.tolist(), gone.tolist(), strict=True):
            own = ids[lo:hi] if not g else ids[lo:hi][~removed[lo:hi]]
            sha.append(hashlib.sha256(b" ".join([words[k] for k in own.tolist()])).hexdigest())
        return pa.table({key: b.rows.column("_c0"), "n_words": sizes, "n_removed": gone, "kept_sha256": sha})

    with block_table(docs, text, [key], lower=False) as (table, buckets, passing):
        return saved(_marked(table, buckets, passing, window, rounds, out, f"{key_fields(docs, key)}, n_words long, n_removed long, kept_sha256 string"), "removed")


def without_repeats(docs: DataFrame, window: int = 35, text: str = "text", rounds: int = ROUNDS, removed: str = "_removed") -> DataFrame:
    """``docs`` with every repeated passage cut from its text (a word goes with
    the white space after it) and a column ``removed``, a name that ``docs`` has
    not, for the number of words cut; texts in which nothing
    repeats, null included, are left as they are."""
    others = [c for c in docs.columns if c != text]
    if removed in docs.columns:
        raise ValueError(f"docs has a column {removed} already")

    def out(b: Block, removed: np.ndarray) -> pa.Table:
        _, gone = _per_document(b, removed)
        texts = b.rows.column("_text").to_pylist()
        for d in np.flatnonzero(gone).tolist():
            hi = int(b.ends[d])
            flags = removed[hi - int(b.sizes[d]):hi].tolist()
            raw = texts[d].encode()
            head = raw[:len(raw) - len(raw.lstrip())]
            texts[d] = (head + b"".join([w for w, r in zip(WORD.findall(raw), flags, strict=True) if not r])).decode()
        return pa.table({**{f"_c{k}": b.rows.column(f"_c{k}") for k in range(len(others))}, "_text": pa.array(texts, pa.string()), "_removed": gone})

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"_c{k} {kinds[c]}" for k, c in enumerate(others)), "_text string", "_removed long"])
    with block_table(docs, text, others, lower=False, keep_text=True) as (table, buckets, passing):
        done = saved(_marked(table, buckets, passing, window, rounds, out, schema), "cut")
    return done.select(*[F.col("_text" if c == text else f"_c{others.index(c)}").alias(c) for c in docs.columns], F.col("_removed").alias(removed))
