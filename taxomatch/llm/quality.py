"""Quality classifier: supervised subword embeddings.

A document's features are its words, the character 3- to 5-grams of each word,
hashed into buckets, and a bucket for word pairs that repeat one word. A learned vector per bucket is averaged over the
document and goes through a softmax layer; both are trained by stochastic
gradient descent in numpy, one document at a time, classes in turn.

Training takes at most PER_CLASS labelled rows of each class, the first in the
order of a hash of their ids. That bounded sample is fitted in one task; the
model that leaves it is one number per bucket (the layer folded into the
vectors), so its broadcast has a fixed size. Every row is scored.

Defined results: null and empty texts have no features and score by the bias
alone; if only one class, or none, is labelled the score is that class, or 0.5;
labels that are null or have no document are ignored; repeated labels count as
often as they come; repeated rows give repeated results; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import key_fields, keyed, map_arrow, raw_texts, resident, saved, text_slices
from taxomatch.session import ship_package

BITS = 18
DIM = 16
GRAMS = (3, 4, 5)
PER_CLASS = 2000
EPOCHS = 6
RATE = 0.5
PULL = 100.0  # rate of the feature vectors against that of the layer
REPEAT = 1 << BITS  # bucket of a word pair that says the same word twice
WORDS = 300_000  # words of which a task keeps the sums


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - BITS - 12) & np.uint64((1 << BITS) - 1)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of the words: the word itself and
    the character n-grams of ``<word>``."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w.decode()}>" for w in words]
    cp = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(m) for m in marked])
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        step = (cp + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        step ^= step >> np.uint64(27)
        place = np.arange(len(cp)) - start[word]
        power = np.cumprod(np.full(int(size.max()), 0x94D049BB133111EB, np.uint64))
        whole = _mix(np.add.reduceat(step * power[place], start))
        at, bucket = [np.arange(len(words))], [whole]
        h = step
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + step[n - 1:]
            if n in GRAMS and len(h):
                inside = np.flatnonzero(word[:len(h)] == word[n - 1:])
                at.append(word[inside])
                bucket.append(_mix(h[inside] + np.uint64(n)))
            if len(h) < 2:
                break
    return np.concatenate(at), np.concatenate(bucket).astype(np.int64)


def document(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share) of a document's features."""
    words, times, parts = {}, [], raw.split()
    for w in parts:
        k = words.setdefault(w, len(words))
        if k == len(times):
            times.append(0)
        times[k] += 1
    at, bucket = features(list(words))
    if not len(at):
        return bucket, np.zeros(0, np.float32)
    bucket, back = np.unique(bucket, return_inverse=True)
    share = np.bincount(back, weights=np.array(times, float)[at])
    rep = sum(map(eq, parts[1:], parts))
    if rep:
        bucket, share = np.append(bucket, REPEAT), np.append(share, rep)
    return bucket.astype(np.int32), (share / share.sum()).astype(np.float32)


def train(raws: list[bytes], labels: list[int], seed: int = 10) -> tuple[np.ndarray, float]:
    """(logit of every bucket, bias) of label 1 against label 0."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(REPEAT + 1, np.float32)
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return flat, 0.0 if not len(y) else (50.0 if y[0] else -50.0)
    docs = [document(r) for r in raws]
    vec = ((rng.random((REPEAT + 1, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    most = max(len(ones), len(zeros))
    steps, done = EPOCHS * 2 * most, 0
    for _ in range(EPOCHS):
        # the classes in turn, the smaller one as often as the larger one
        order = np.stack([rng.permutation(np.resize(rng.permutation(c), most)) for c in (ones, zeros)], axis=1).ravel()
        for d in order:
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            bucket, share = docs[d]
            rows = vec[bucket]
            mean = share @ rows
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            push = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= rate * p
            vec[bucket] = rows - (rate * PULL * share)[:, None] * push
    return vec @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> tuple[np.ndarray, float]:
    """Fit on the labelled rows for which ``usable``, a condition on the key of
    ``labels``, holds."""
    known = labels.where(usable & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    order = [F.xxhash64("_key", F.lit(10)), "_key"]
    picked = known.where("_label = 1").orderBy(*order).limit(per_class).unionAll(known.where("_label = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class ids
    sample = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(picked), "_key")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_key", "ascending"), ("_label", "ascending"), ("_text", "ascending")])
        logit, bias = train(raw_texts(group.column("_text").combine_chunks()), group.column("_label").to_pylist())
        return pa.table({"logit": [logit.astype("<f4").tobytes()], "bias": [bias]})

    ship_package(docs.sparkSession)
    model = saved(sample.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(run, "logit binary, bias double"), "quality-model").first()
    if model is None:
        return train([], [])
    return np.frombuffer(model["logit"], "<f4"), model["bias"]


class Scorer:
    """Keeps the summed logits and the number of features of words."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias = logit.astype(np.float64), bias
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.total, self.count = np.zeros(0), np.zeros(0)

    def score(self, raws: list[bytes]) -> np.ndarray:
        if len(self.known) > WORDS:
            self.reset()
        parts = [r.split() for r in raws]
        words = [w for p in parts for w in p]
        new = [w for w in set(words) if w not in self.known]
        if new:
            at, bucket = features(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.total = np.concatenate([self.total, np.bincount(at, weights=self.logit[bucket], minlength=len(new))])
            self.count = np.concatenate([self.count, np.bincount(at, minlength=len(new))])
        if not words:
            return np.full(len(raws), 1 / (1 + np.exp(-self.bias)))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends = np.array([*accumulate(map(len, parts), initial=0)])
        upto = np.concatenate([[0], np.cumsum(self.total[at])]), np.concatenate([[0], np.cumsum(self.count[at])])
        total, count = (u[ends[1:]] - u[ends[:-1]] for u in upto)
        again = np.concatenate([[0, 0], np.cumsum(at[1:] == at[:-1])])  # pairs that end before a word
        inner = np.maximum(ends[:-1] + 1, 1)  # a document's first word ends no pair of its own
        rep = np.where(ends[1:] > ends[:-1], again[ends[1:]] - again[np.minimum(inner, len(at))], 0)
        total, count = total + rep * self.logit[REPEAT], count + rep
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        scorer = Scorer(*shared.value)
        for b in text_slices(batches, "_text"):
            s = scorer.score(raw_texts(b.column("_text")))
            yield keyed({key: b.column(0), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    src = docs.select(key, docs[text].cast("string").alias("_text"))
    return map_arrow(src, run, f"{key_fields(src, key)}, score double, predicted int")


def keep(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        scorer = Scorer(*shared.value)
        for b in text_slices(batches, text):
            yield b.filter(pa.array(scorer.score(raw_texts(b.column(text))) >= least))

    return map_arrow(docs, run, docs.schema)
