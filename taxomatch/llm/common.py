"""Helpers shared by the training-data operators.

Every operator selects just the key and text (or vector) columns it needs, so
extra columns of the input, whatever their names, cannot clash with results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.session import scratch_dir, ship_package

#: Texts are handled in slices of about this many bytes, whatever a row holds.
SLICE_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str, passing: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the plan
    runs once, and later stages survive the loss of any executor. The path is
    added to ``passing``, for a caller that deletes it when it is done."""
    path = scratch_dir(df.sparkSession, name)
    if passing is not None:
        passing.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_RESIDENT: dict = {}


def resident(kind=None, make: Callable = lambda: None):
    """What a worker process keeps between tasks: one thing at a time, so the
    tables of one operator do not weigh on the next. Called without arguments
    it only lets go of the last one."""
    if kind not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[kind] = make()
        pa.default_memory_pool().release_unused()
    return _RESIDENT[kind]


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``limit`` bytes of
    text (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        lo = 0
        while lo < b.num_rows:
            done = end[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(end, done + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def key_fields(df: DataFrame, *cols: str) -> str:
    """The columns' names and types, to head an output schema."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in cols)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def keyed(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()],
                                      names=list(columns))


def crc_mod(col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % mod
