"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: XXH64 (seed 42) of every word shingle, repeats included; a bit is
set if it is set in over half of the hashes. Equal fingerprints are one class.

Search: a fingerprint's population counts per 16-bit segment name its tile. Two
fingerprints within the radius differ in those counts by no more than the
radius in sum, so tile pairs beyond it are skipped; every other pair of tiles
is compared exactly with exclusive-or and bit counts in numpy. There are at
most 17**4 combinations of counts, whatever the input; a combination with more
than TILE fingerprints is cut into several tiles. A pair of tiles returns a
forest of its links, not the links, so a large group of near copies stays
linear. Components join the forests.

Defined results: null and empty texts, and texts of white space only, have
fingerprint zero and are linked like any other; fewer words than a shingle make
one shingle; rows with the same id each keep their row; rows with a null id
take part, and a component of null ids alone has a null component id; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxomatch.llm.common import fresh_name, key_fields, keyed, map_arrow, raw_texts, resident, saved, text_slices
from taxomatch.llm.components import components, forest

SEGMENTS = 4
TILE = 4096


def fingerprint(raw: bytes, shingle: int) -> int:
    """64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = raw.lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), parts), "<u8", n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) of every row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for b in text_slices(batches, "_text"):
            fp = np.array([fingerprint(x, shingle) for x in raw_texts(b.column("_text"))], np.uint64)
            yield keyed({key: b.column(0), "fp": fp.view(np.int64)})

    src = docs.select(key, docs[text].cast("string").alias("_text"))
    return map_arrow(src, run, f"{key_fields(src, key)}, fp long")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles: positions in a followed by b
    (in a alone if both are one tile)."""
    n = len(a) if same else len(a) + len(b)
    shift = 0 if same else len(a)
    us, vs = [], []
    step = max(1, (1 << 20) // len(b))
    for lo in range(0, len(a), step):
        near = np.bitwise_count(a[lo:lo + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        u, v = forest(n, i + lo, j + shift)
        us.append(u)
        vs.append(v)
    return forest(n, np.concatenate(us), np.concatenate(vs))


def links(fps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): forests of all links between the distinct fingerprints ``fp``."""
    width = 64 // SEGMENTS
    base = width + 1
    pops = [F.bit_count(F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit((1 << width) - 1))) for s in range(SEGMENTS)]
    place = sum((p.cast("long") * base ** s for s, p in enumerate(pops)), F.lit(0))
    homes = fps.select("fp", place.alias("place"), *[p.cast("int").alias(f"p{s}") for s, p in enumerate(pops)])
    # at most base ** SEGMENTS places, so the join with their sizes may be a broadcast
    many = homes.groupBy("place").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    homes = homes.join(F.broadcast(many), "place")
    tiles = homes.groupBy("place", *[f"p{s}" for s in range(SEGMENTS)], F.pmod(F.xxhash64("fp"), "tiles").alias("tile")).agg(F.collect_list("fp").alias("fps"))
    tiles = saved(tiles, "tiles")
    zero = (0,) * SEGMENTS
    moves = [d for d in itertools.product(range(-radius, radius + 1), repeat=SEGMENTS) if sum(map(abs, d)) <= radius and d >= zero]
    near = F.array(*[F.struct(*[F.lit(x).alias(f"d{s}") for s, x in enumerate(d)]) for d in moves])
    here = tiles.withColumn("d", F.explode(near))
    for s in range(SEGMENTS):
        here = here.where(F.col(f"p{s}") + F.col(f"d.d{s}") >= 0).where(F.col(f"p{s}") + F.col(f"d.d{s}") <= width)
    here = here.select((F.col("place") + sum(F.col(f"d.d{s}").cast("long") * base ** s for s in range(SEGMENTS))).alias("there"),
                       F.col("place").alias("from"), F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a"))
    pairs = here.join(tiles.select(F.col("place").alias("there"), F.col("tile").alias("tile_b"), F.col("fps").alias("fps_b")), "there")
    pairs = pairs.where("`from` <> there or tile_a <= tile_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            same = batch.column("same").to_numpy(zero_copy_only=False)
            left, right = batch.column("fps_a"), batch.column("fps_b")
            for k in range(batch.num_rows):
                x = left[k].values.to_numpy().view(np.uint64)
                y = right[k].values.to_numpy().view(np.uint64)
                u, v = near_pairs(x, y, radius, bool(same[k]))
                if len(u):
                    both = x if same[k] else np.concatenate([x, y])
                    a.append(both[u])
                    b.append(both[v])
            if a:
                yield keyed({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    pairs = pairs.select("fps_a", "fps_b", F.expr("`from` = there and tile_a = tile_b").alias("same"))
    return map_arrow(pairs, run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): fingerprint as 16 hexadecimal digits,
    component_id the smallest key reachable over links, one row per input row."""
    rows = saved(fingerprints(docs, shingle, key, text), "fingerprints")
    kinds = rows.groupBy("fp").agg(F.min(key).alias("least"))
    kinds = saved(kinds, "fingerprint-classes")
    joined = components(links(kinds, radius))
    label = kinds.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.select("fp", "component").join(best, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest key, a null key
    first, then the first row. Rows are told apart by a number of their own, so
    repeated and null keys do no harm."""
    row = fresh_name(docs, "_row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, shingle, radius, row, text).select(row, "component_id")
    first = rows.select(row, F.col(key).alias("_key")).join(found, row).groupBy("component_id").agg(F.min(F.struct("_key", row)).alias("first"))
    return rows.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").drop(row)
