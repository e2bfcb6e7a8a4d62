"""Hierarchical Pitman-Yor language model over word pairs.

Restaurants: one for each context word (and one for the start of a text), all
with one parent restaurant over words, whose parent is uniform over the known
words and one unknown. A customer of a context restaurant is a training token
after that context; each of its tables is a customer of the parent.

Seating is sampled by Gibbs sweeps over table counts: for each dish of each
restaurant the number of tables is drawn given its customers, the restaurant's
other tables and the parent's probabilities of the previous sweep, from the
conditional at any number of customers: generalised Stirling numbers by their
recursion up to EXACT customers, beyond that as ``stirling`` gives them. The
dishes of a sweep are drawn side by side, each against the others' tables of the
previous sweep; its own are not among them. (A word of the parent restaurant:
its own are drawn again for its present customers, as no one keeps the former
number.) The draws come from a hash of (context, word, sweep), so all blocks that
hold a dish draw the same number; a block writes what it drew beside its sums
and reads it in later passes, so each sweep is drawn once. A token's probability
is averaged over the sampled seatings.

Counts come from the whole corpus: blocks ask for the counts of their distinct
words and pairs, and buckets of hash ranges sum them; the block that a bucket
names as a pair's owner adds the pair's tables to the sums of its two words.

Defined results: null and empty texts are the end token alone; a null id counts
as training; without training tokens every probability is 1 of 1 known outcome;
repeated rows count as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import key_fields, saved
from taxomatch.llm.recompress import ODD, mix
from taxomatch.llm.stirling import few_tables, lgamma, log_stirling
from taxomatch.llm.wordblocks import Block, answer, ask, block_table, cut, with_answers

END = np.uint64(0x5D1F0C2E9A7B3846)  # names of the two marks
BEGIN = np.uint64(0xA8C3E1F7246B590D)
SAMPLES = 2
EXACT = 64
CELLS = 128  # steps of the draw of a large number
FEW, ROWS = 40, 8192  # tables and customers whose Stirling numbers are kept
STRENGTH = 1.0
QUESTION = "bucket int, block long, a binary, b binary, c binary"
ANSWER = "kind string, bucket int, block long, a binary, b binary, c binary, x long, y long"
SEATED = -1 << 31  # in place of a bucket: a row that is kept for its own block


def uniform(names: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(names ^ mix(np.uint64(salt + 1) * ODD)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers [customers, tables]."""
    s = np.full((EXACT + 1, EXACT + 2), -np.inf)
    s[1, 1] = 0
    for c in range(1, EXACT):
        t = np.arange(1, EXACT + 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            s[c + 1, 1:-1] = np.logaddexp(s[c, :-2], np.log(np.maximum(c - discount * t, 1e-300)) + s[c, 1:-1])
        s[c + 1, c + 2:] = -np.inf
    return s


def draw_tables(count: np.ndarray, names: np.ndarray, salt: int, discount: float, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Tables of each dish. others: tables of the restaurant's other dishes."""
    tables = np.minimum(count, 1)
    log_s = stirling(discount).astype(np.float32)
    more = np.flatnonzero(count > 1)  # a single customer has one table
    small = np.minimum(count[more], EXACT).astype(np.uint8)
    more = more[np.argsort(small, kind="stable")]
    edges = np.cumsum(np.bincount(small, minlength=EXACT + 1))
    for c in np.flatnonzero(np.diff(edges, prepend=0)).tolist():
        at, t = more[edges[c - 1]:edges[c]], np.arange(c)
        for lo in range(0, len(at), (1 << 18) // c):
            k = at[lo:lo + (1 << 18) // c]
            # log weight of 1, 2, ... tables; single precision is ample for a draw
            w = (STRENGTH + discount * others[k]).astype(np.float32)[:, None] + (discount * t).astype(np.float32)
            w *= parent[k].astype(np.float32)[:, None]
            np.log(w, out=w)
            np.cumsum(w, axis=1, out=w)
            w += log_s[c, 1:c + 1]
            w -= w.max(axis=1, keepdims=True)
            np.exp(w, out=w)
            np.cumsum(w, axis=1, out=w)
            tables[k] = 1 + (w < (uniform(names[k], salt) * w[:, -1]).astype(np.float32)[:, None]).sum(axis=1)
    large = np.flatnonzero(count > EXACT)
    for lo in range(0, len(large), 4096):
        k = large[lo:lo + 4096]
        tables[k] = _draw_large(count[k], uniform(names[k], salt), discount, others[k], parent[k])
    return tables


def _near_peak(count: np.ndarray, falls) -> np.ndarray:
    """A number from 1 to count no further from the first for which ``falls``
    holds (and then for all after it) than its square root, a fraction of what
    is weighed around it. Halved by proportion, each dish by itself."""
    lo, hi = np.ones(len(count)), count.astype(np.float64)  # falls at hi, not before lo
    todo = np.arange(len(count))
    while len(todo):
        mid = np.floor(np.sqrt(lo[todo] * hi[todo]))
        down = falls(todo, mid.astype(np.int64))
        hi[todo[down]] = mid[down]
        lo[todo[~down]] = mid[~down] + 1
        todo = todo[hi[todo] - lo[todo] > np.sqrt(lo[todo])]
    return hi.astype(np.int64)


def _draw_large(count: np.ndarray, u: np.ndarray, discount: float, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Tables of dishes of more than EXACT customers. Where numbers beyond FEW
    weigh nothing, all up to FEW are weighed, else those around the peak."""
    base, each = STRENGTH / discount + others, np.log(discount * parent)
    known, which = np.unique(count, return_inverse=True)
    t, kept = np.arange(1, FEW + 1), known < ROWS
    rows = np.empty((len(known), FEW))
    rows[kept] = few_tables(discount, ROWS, FEW)[known[kept]]
    rows[~kept] = log_stirling(discount, known[~kept][:, None], t)
    w = np.cumsum(np.log(base[:, None] + (t - 1)), axis=1) + each[:, None] * t + rows[which]
    w -= w.max(axis=1, keepdims=True)
    many = np.flatnonzero(w[:, -1] > -30)
    w = np.cumsum(np.exp(w), axis=1)
    out = 1 + (w < (u * w[:, -1])[:, None]).sum(axis=1)
    if len(many):
        out[many] = _draw_peak(count[many], u[many], discount, base[many], each[many])
    return out


def _draw_peak(count: np.ndarray, u: np.ndarray, discount: float, base: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The weights of 1, 2, ... tables have one peak, no wider than a Poisson
    distribution's; the numbers around it lie in up to CELLS cells, of one
    number each where they are few."""

    def weight(t: np.ndarray, k=slice(None)) -> np.ndarray:
        return t * each[k] + lgamma(base[k] + t) + log_stirling(discount, count[k], t)

    peak = _near_peak(count, lambda k, t: weight(np.minimum(t + 1, count[k]), k) <= weight(t, k))
    reach = (8 * np.sqrt(peak)).astype(np.int64) + 12
    first, end = np.maximum(peak - reach, 1), np.minimum(peak + reach, count) + 1
    width = -(-(end - first) // CELLS)
    start = first + width * np.arange(CELLS)[:, None]
    w = weight(np.clip(start + (width - 1) / 2, 1, count))
    w = np.where(start < end, np.exp(w - w.max(axis=0)), 0) * np.clip(end - start, 0, width)
    upto = np.cumsum(w, axis=0)
    u = u * upto[-1]
    cell = np.minimum((upto < u).sum(axis=0), CELLS - 1)
    at = cell, np.arange(len(cell))
    inside = (u - upto[at] + w[at]) / w[at] * np.minimum(width, end - start[at])
    return np.clip(start[at] + inside.astype(np.int64), 1, end - 1)


def classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, start of each among the
    sorted places, sorted places). Unlike numpy's unique it does without a
    stable sort."""
    order = _order(x)
    y = x[order]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    start = np.flatnonzero(new)
    return y[start], order[start], start, order


def _order(x: np.ndarray) -> np.ndarray:
    """As argsort: the hashes' high bits are sorted with the places in their low
    ones, which numpy does several times faster; if that leaves any two out of
    order, they are sorted in full."""
    low = np.uint64((1 << max(1, int(len(x)).bit_length())) - 1)
    order = (np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    y = x[order]
    return order if (y[1:] >= y[:-1]).all() else np.argsort(x)


def pack(x: np.ndarray) -> bytes:
    """Counts as bytes, those from 255 on once more in full at the end."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    if len(raw) > n:
        out[out == 255] = np.frombuffer(raw[n:], "<i8")
    return out


class Tokens:
    """A block's tokens, its distinct words (the two marks last) and pairs."""

    def __init__(self, b: Block):
        self.block, self.rows = b.block, b.rows
        held = np.array(b.rows.column("_c1").to_pylist(), bool)
        self.words = np.concatenate([b.hashes(1), np.array([END, BEGIN], np.uint64)])
        n = len(self.words) - 2
        self.size = b.sizes + 1
        self.ends = np.cumsum(self.size)
        last = self.ends - 1
        self.token = np.full(int(self.size.sum()), n, np.int64)
        inner = np.ones(len(self.token), bool)
        inner[last] = False
        self.token[inner] = b.ids
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[self.ends - self.size] = n + 1
        train = np.repeat(~held, self.size)
        self.count = np.bincount(self.token[train], minlength=n + 2)
        self.count[n + 1] = (~held).sum()
        with np.errstate(over="ignore"):
            pair = mix(mix(self.words)[context] * np.uint64(5) + self.words[self.token] * ODD)
        self.pairs, at, start, self._sorted = classes(pair)
        self.context, self.word = context[at], self.token[at]
        self.pair_count = np.add.reduceat(train[self._sorted].astype(np.int64), start)
        self._start = start
        self.order = _order(self.words)

    @property
    def pair(self) -> np.ndarray:
        """The pair of each token."""
        out = np.empty(len(self._sorted), np.int64)
        out[self._sorted] = np.repeat(np.arange(len(self.pairs)), np.diff(self._start, append=len(self._sorted)))
        return out

    def put(self, sorted_values: np.ndarray) -> np.ndarray:
        """Values in the order of the sorted words back to the words' order."""
        out = np.empty_like(sorted_values)
        out[self.order] = sorted_values
        return out


def _questions(block: int, hashes: np.ndarray, columns: list[np.ndarray], buckets: int, pairs: bool) -> pa.RecordBatch:
    parts = cut(hashes, buckets)
    blobs = [pa.array([hashes[s].tobytes() for _, s in parts], pa.binary()), *(pa.array([pack(x[s]) for _, s in parts], pa.binary()) for x in columns)]
    blobs += [pa.array([None] * len(parts), pa.binary())] * (3 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array([-1 - k if pairs else k for k, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), *blobs],
                                      names=["bucket", "block", "a", "b", "c"])


def _answers(kind: str, bucket: int, blocks: list[int], a: list, b: list, total: tuple[int, int], c: list | None = None) -> pa.Table:
    """The answers, and a row of the bucket's totals."""
    n = len(blocks)
    c = c or [None] * n
    return pa.table({"kind": [kind] * n + ["total " + kind], "bucket": pa.array([bucket] * (n + 1), pa.int32()), "block": pa.array([*blocks, -1], pa.int64()),
                     "a": pa.array([*a, None], pa.binary()), "b": pa.array([*b, None], pa.binary()), "c": pa.array([*c, None], pa.binary()),
                     "x": pa.array([None] * n + [int(total[0])], pa.int64()), "y": pa.array([None] * n + [int(total[1])], pa.int64())})


class Asked:
    """The questions of one bucket: all hashes, their classes, and sums over
    the classes of a column of counts."""

    def __init__(self, group: pa.Table):
        parts = [np.frombuffer(x, np.uint64) for x in group.column("a").to_pylist()]
        self.group, self.sizes = group, [len(p) for p in parts]
        self.bucket, self.blocks = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
        self.flat = np.concatenate(parts)
        self.known, _, self.start, self.order = classes(self.flat)
        self.times = np.diff(self.start, append=len(self.flat))

    def sums(self, column: str) -> np.ndarray:
        x = np.concatenate([unpack(r, n) for r, n in zip(self.group.column(column).to_pylist(), self.sizes, strict=True)])
        return np.add.reduceat(x[self.order], self.start)

    def back(self, of_class: np.ndarray) -> list[np.ndarray]:
        """A value per class as one array per question."""
        out = np.empty(len(self.flat), of_class.dtype)
        out[self.order] = np.repeat(of_class, self.times)
        return np.split(out, np.cumsum(self.sizes)[:-1])


def _counted(group: pa.Table) -> pa.Table:
    """Sums of the counts of words (buckets from 0) or pairs (below)."""
    group = group.sort_by("block")  # a pair's owner is the first block that asks
    q = Asked(group)
    total = q.sums("b")
    if q.bucket >= 0:
        words = q.known != BEGIN
        return _answers("words", q.bucket, q.blocks, [pack(x) for x in q.back(total)], [None] * len(q.blocks),
                        (total[words].sum(), (total[words] > 0).sum()))
    owner = np.zeros(len(q.flat), bool)
    owner[np.minimum.reduceat(q.order, q.start)] = True
    bits, counts = [], []
    for s, o, c in zip(q.back(q.times > 1), np.split(owner, np.cumsum(q.sizes)[:-1]), q.back(total), strict=True):
        bits.append(np.packbits(np.concatenate([s, o])).tobytes())
        counts.append(pack(c[s]))
    return _answers("pairs", q.bucket, q.blocks, bits, counts, ((total == 1).sum(), (total == 2).sum()))


class Told:
    """What a block has been told, in the order of its words and pairs:
    ``sums[s]`` customers, context tables and own tables of its words after
    sweep s, ``seated[s]`` the tables of its pairs that it drew itself."""

    def __init__(self, t: Tokens, answers: pa.Table, buckets: int):
        got = {(k, n): blobs for k, n, *blobs in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "a", "b", "c")), strict=True)}
        in_order = t.words[t.order]

        def words(kind: str, part: int) -> np.ndarray:
            return t.put(np.concatenate([unpack(got[kind, k][part], s.stop - s.start) for k, s in cut(in_order, buckets)]))

        self.count = words("words", 0)
        self.pair_count, self.owner = t.pair_count.copy(), np.zeros(len(t.pairs), bool)
        for k, s in cut(t.pairs, buckets):
            bits, counts, _ = got["pairs", -1 - k]
            shared, owner = np.split(np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * (s.stop - s.start)).astype(bool), 2)
            self.owner[s] = owner
            self.pair_count[np.flatnonzero(shared) + s.start] = unpack(counts, int(shared.sum()))
        self.seated = {0: np.minimum(self.pair_count, 1)}  # one table each at first
        self.sums = {}
        for kind, bucket in got:
            if bucket == SEATED:
                self.seated[int(kind.removeprefix("seated "))] = unpack(got[kind, bucket][0], len(t.pairs))
        for kind in {k for k, n in got if n != SEATED} - {"words", "pairs"}:
            self.sums[int(kind)] = tuple(words(kind, part) for part in range(3))


class Seating:
    """The seatings of the sweeps. scalars[s]: (customers, tables) of the
    parent restaurant after sweep s."""

    def __init__(self, pair_discount: float, word_discount: float, outcomes: int, scalars: list[tuple[int, int]]):
        self.pair_discount, self.word_discount, self.outcomes, self.scalars = pair_discount, word_discount, outcomes, scalars

    def parent(self, sweep: int, customers: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Probability of each word in the parent restaurant, by its customers
        and tables there."""
        total, tables = self.scalars[sweep]
        fresh = (STRENGTH + self.word_discount * tables) / self.outcomes
        return (np.maximum(customers - self.word_discount * own, 0) + fresh) / (STRENGTH + total)

    def word_tables(self, sweep: int, customers: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Tables of each word in the parent restaurant: one at first."""
        if sweep == 0:
            return np.minimum(customers, 1)
        others = np.maximum(self.scalars[sweep - 1][1] - self.word_tables(sweep - 1, customers, words), 0)
        return draw_tables(customers, words, 7000 + sweep, self.word_discount, others, np.full(len(customers), 1 / self.outcomes))

    def pair_tables(self, sweep: int, t: Tokens, told: Told) -> np.ndarray:
        """Tables of each pair of a block after a sweep, drawn from what is
        known after the one before."""
        if sweep in told.seated:
            return told.seated[sweep]
        customers, tables, own = told.sums[sweep - 1]
        others = tables[t.context] - told.seated[sweep - 1]
        parent = self.parent(sweep - 1, customers, own)[t.word]
        return draw_tables(told.pair_count, t.pairs, sweep, self.pair_discount, np.maximum(others, 0), parent)

    def probability(self, sweep: int, t: Tokens, told: Told) -> np.ndarray:
        """Predictive probability of each pair of a block."""
        customers, tables, own = told.sums[sweep]
        parent = self.parent(sweep, customers, own)[t.word]
        seen = told.count[t.context]
        fresh = STRENGTH + self.pair_discount * tables[t.context]
        inside = (np.maximum(told.pair_count - self.pair_discount * told.seated[sweep], 0) + fresh * parent) / (STRENGTH + seen)
        return np.where(seen > 0, inside, parent)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _totals(answers: DataFrame) -> dict[str, tuple[int, int]]:
    """The buckets' totals, summed, by kind."""
    rows = answers.where("kind like 'total %'").groupBy("kind").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()
    return {r["kind"].removeprefix("total "): (r["x"], r["y"]) for r in rows}


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row; the rows for which ``held_out`` is not true are learned from."""
    docs = docs.select(key, F.col(text).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))

    with block_table(docs, "_text", [key, "_held"], lower=True, hashed=True) as (table, buckets, passing):

        def counts(b: Block) -> Iterator[pa.RecordBatch]:
            t = Tokens(b)
            yield _questions(t.block, t.words[t.order], [t.count[t.order]], buckets, False)
            yield _questions(t.block, t.pairs, [t.pair_count], buckets, True)

        base = saved(answer(ask(table, counts, QUESTION), _counted, ANSWER), "counts", passing)
        total = _totals(base)
        n, v = total.get("words", (0, 0))
        seats = Seating(_discount(*total.get("pairs", (0, 0))), 0.5, v + 1, [])
        base = base.where("kind in ('words', 'pairs')")
        sums: list[DataFrame] = []
        for sweep in range(samples + 1):
            customers, tables, word_discount = _sweep(table, base, sums, seats, sweep, buckets, passing)
            if sweep == 0:
                seats.word_discount = word_discount
            seats.scalars.append((customers, tables))
    
        def scores(b: Block, answers: pa.Table) -> pa.Table:
            t = Tokens(b)
            told = Told(t, answers, buckets)
            p = np.mean([seats.probability(s, t, told) for s in range(1, samples + 1)], axis=0)
            own = told.count[t.token]
            first = t.ends - t.size
            unigram = np.log10((own + 0.1) / (n + 0.1 * (v + 1)))
            return pa.table({key: t.rows.column("_c0"), "held_out": t.rows.column("_c1"), "n_tokens": t.size,
                             "n_known": np.add.reduceat((own > 0).astype(np.int64), first), "train_tokens": np.full(len(first), n),
                             "base_score": np.add.reduceat(unigram, first), "score": np.add.reduceat(np.log10(p)[t.pair], first)})

        every = base
        for s in sums:
            every = every.unionAll(s)
        schema = f"{key_fields(docs, key)}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return saved(with_answers(table, every, scores, schema), "scores")


def _sweep(table: DataFrame, base: DataFrame, sums: list[DataFrame], seats: Seating, sweep: int, buckets: int,
           passing: list[str]) -> tuple[int, int, float]:
    """Seat every dish once; append to ``sums`` the sums per word and what each
    block has drawn, for its later passes. Returns the parent restaurant's
    customers and tables, and its discount by the counts."""

    def tables(b: Block, answers: pa.Table) -> pa.Table:
        t = Tokens(b)
        told = Told(t, answers, buckets)
        drawn = seats.pair_tables(sweep, t, told)
        own = np.where(told.owner, drawn, 0).astype(np.int64)
        as_word, as_context = (np.bincount(x, weights=own, minlength=len(t.words)).astype(np.int64)[t.order] for x in (t.word, t.context))
        asked = _questions(t.block, t.words[t.order], [as_word, as_context], buckets, False)
        none = pa.array([None], pa.binary())
        kept = pa.RecordBatch.from_arrays([pa.array([SEATED], pa.int32()), pa.array([t.block], pa.int64()), pa.array([pack(drawn)], pa.binary()), none, none], schema=asked.schema)
        return pa.Table.from_batches([asked, kept] if sweep else [asked])

    def summed(group: pa.Table) -> pa.Table:
        q = Asked(group)
        customers = q.sums("b")
        own = seats.word_tables(sweep, customers, q.known)
        out = _answers(str(sweep), q.bucket, q.blocks, [pack(x) for x in q.back(customers)], [pack(x) for x in q.back(q.sums("c"))],
                       (customers.sum(), own.sum()), [pack(x) for x in q.back(own)])
        # counts of counts, for the discount
        more = _answers("few", q.bucket, [], [], [], ((customers == 1).sum(), (customers == 2).sum()))
        return pa.concat_tables([out, more])

    told = base
    for s in sums:
        told = told.unionAll(s)
    asked = saved(with_answers(table, told, tables, QUESTION), "drawn", passing)
    done = saved(answer(asked.where(F.col("bucket") != SEATED), summed, ANSWER), "sums", passing)
    kept = asked.where(F.col("bucket") == SEATED).selectExpr(f"'seated {sweep}' as kind", "bucket", "block", "a", "b", "c", "cast(null as bigint) as x", "cast(null as bigint) as y")
    sums.append(done.where("kind not like 'total %'").unionAll(kept))
    total = _totals(done)
    return *total.get(str(sweep), (0, 0)), _discount(*total.get("few", (0, 0)))
