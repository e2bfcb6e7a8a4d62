"""Scans and sinks: delimited text, Parquet/JSON dispatch, weights file.

Delimited files are read as all-string tables with an explicit schema built
from the header (no type inference pass), RFC-4180 quoting (``escape='"'``)
and, on request, multi-line values (such a file cannot be split, so it is one
task). Column lists are applied as a projection, which Spark
pushes into the scan.
"""

from __future__ import annotations

import csv
import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.functions.text import strip_ws
from taxomatch.functions.vectors import TUNED_WEIGHTS, WEIGHT_NAMES

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "mode": "PERMISSIVE"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = (spark.read.option("sep", sep).option("header", "false").option("escape", '"')
             .csv(path).limit(1).collect())  # the header row only
    return [c for c in first[0]] if first else []


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None,
                   sep: str = "\t", multi_line: bool = False, na_values: tuple[str, ...] = ()) -> DataFrame:
    """All-string scan; keeps the listed columns that exist (in list order).
    A missing path gives an empty table of the listed columns. ``na_values``
    are read as null."""
    if not _exists(spark, path):
        cols = columns or []
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in cols]))
    header = _header(spark, path, sep)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).option("sep", sep).schema(schema).csv(path)
    if na_values:
        df = df.select(*[F.when(~F.col(f"`{c}`").isin(*na_values), F.col(f"`{c}`")).alias(c) for c in header])
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns if c in header])
    return df


def _headers(spark: SparkSession, path: str, sep: str, threads: int) -> dict[tuple[str, ...], list[str]]:
    """Files under ``path`` by their header. The listing is Spark's; of each
    file the driver reads the first line, ``threads`` files at a time. Empty
    files have none."""
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str):
        p = jvm.org.apache.hadoop.fs.Path(file)
        stream = p.getFileSystem(conf).open(p)
        codec = codecs.getCodec(p)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()

    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(threads) as pool:
        for file, line in zip(files, pool.map(first_line, files), strict=True):
            if line:
                groups.setdefault(tuple(next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep))), []).append(file)
    return groups


def read_folder(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t", multi_line: bool = False,
                malformed: str = "_malformed", file: str | None = None, threads: int = 16) -> DataFrame:
    """All-string scan of a folder of delimited files, each with a header of its
    own: columns are matched by name, in any order; a column that a file lacks
    is null there. Files of one header are one scan.

    A row with more or fewer cells than its file's header keeps its place, with
    the whole line in the column ``malformed`` (null for good rows): see
    ``malformed_counts``; a result without that column reads only its own
    columns. ``columns``: those of them that some file has, in list
    order; ``file`` names a column for the file's path. A header name that
    repeats in one file, or is one of the two names above, is an error; a header
    holds no line breaks. A missing or empty folder gives an empty table."""
    found = _headers(spark, path, sep, threads) if _exists(spark, path) else {}
    extra = [malformed, *([file] if file else [])]
    for header in found:
        if len(set(header)) < len(header) or set(header) & set(extra):
            raise ValueError(f"header {header} repeats a name or uses one of {extra}: {found[header][0]}")
    every = list(dict.fromkeys(c for header in sorted(found) for c in header))
    keep = [c for c in columns if c in every] if columns is not None else every
    scans = []
    for header in sorted(found):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, malformed)])
        df = (spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).option("sep", sep)
              .option("columnNameOfCorruptRecord", malformed).schema(schema).csv(found[header]))
        # Spark counts the cells of a row only where all columns are read: this one asks for them
        bad = F.when(F.coalesce(*[F.col(f"`{c}`") for c in (*header, malformed)]).isNotNull(), F.col(f"`{malformed}`")).alias(malformed)
        scans.append(df.select(*[(F.col(f"`{c}`") if c in header else F.lit(None).cast("string")).alias(c) for c in keep],
                               bad, *([F.col("_metadata.file_path").alias(file)] if file else [])))
    if not scans:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (*(columns or []), *extra)]))
    return reduce(DataFrame.unionByName, scans)


def malformed_counts(df: DataFrame, by: str, malformed: str = "_malformed") -> DataFrame:
    """Rows and malformed rows per value of ``by`` (the file column, say)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count(malformed).alias("malformed"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Dispatch on the suffix: .csv, .tsv/.txt, .json/.jsonl, else Parquet."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return read_delimited(spark, path, columns, ",", multi_line)
    if ext in (".tsv", ".txt"):
        return read_delimited(spark, path, columns, "\t", multi_line)
    if ext in (".json", ".jsonl"):
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


SHEET_SUFFIXES = (".parquet", ".csv", ".tsv", ".txt", ".json", ".jsonl")


def read_sheet(spark: SparkSession, book: str, sheet: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A sheet of a workbook. A workbook is a folder (or archive unpacked into
    one) that holds each sheet as a table named ``<sheet>.<suffix>``; the
    suffix picks the reader."""
    for ext in SHEET_SUFFIXES:
        path = f"{book.rstrip('/')}/{sheet}{ext}"
        if _exists(spark, path):
            return read_table(spark, path, columns, multi_line)
    raise FileNotFoundError(f"{book} has no sheet {sheet!r}")


def strip_all(df: DataFrame) -> DataFrame:
    """Strip every string column (whitespace, not only spaces)."""
    return df.select(*[strip_ws(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def fill_blank(df: DataFrame) -> DataFrame:
    """Nulls in string columns become ''."""
    return df.na.fill({c: "" for c, t in df.dtypes if t == "string"})


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Header, RFC-4180 quoting, values kept byte for byte (Spark's writer
    trims leading/trailing whitespace unless told not to)."""
    (df.write.mode(mode).options(**CSV_OPTIONS)
     .option("sep", sep).option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .csv(path))


def preview(df: DataFrame, order_by, n: int = 3) -> DataFrame:
    """First ``n`` rows in a stated order (a limit is the feature here)."""
    return df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(n)


def read_weights(spark: SparkSession, path: str | None, defaults: dict[str, float] = TUNED_WEIGHTS) -> DataFrame:
    """Field weights ``(field, weight)``: known fields take the file's value
    when present, else the default; unknown fields in the file are ignored."""
    d = spark.createDataFrame([(i, n, float(defaults[n])) for i, n in enumerate(WEIGHT_NAMES)],
                              "ord int, field string, default_weight double")
    if path is None or not _exists(spark, path):
        return d.select("field", F.col("default_weight").alias("weight"))
    # a repeated field: the last row in file order wins
    f = (read_delimited(spark, path, ["field", "weight"], sep=",")
         .select(strip_ws("field").alias("field"), F.col("weight").try_cast("double").alias("file_weight"),
                 F.monotonically_increasing_id().alias("_pos"))
         .groupBy("field").agg(F.max_by("file_weight", "_pos").alias("file_weight")))
    # the six known fields (fixed size) are the broadcast side; unknown fields drop out
    return (f.join(F.broadcast(d), "field", "right")
            .orderBy("ord")
            .select("field", F.coalesce("file_weight", "default_weight").alias("weight")))


def weights_dict(weights: DataFrame) -> dict[str, float]:
    """Six numbers to the driver (bounded)."""
    return {r["field"]: float(r["weight"]) for r in weights.collect()}


# The two mock user rows the reference writes when its input file is absent.
MOCK_USER_ROWS = (
    (1, "Budget Director", "I manage finances, analyze budget reports, and handle investments."),
    (2, "Code Writer", "I write python scripts, debug software, and manage databases."),
)


def read_user_input(spark: SparkSession, path: str, mock_if_missing: bool = False) -> DataFrame:
    """User rows ``User_ID, User_Job_Title, User_Job_Description`` from csv,
    nulls as ''. With ``mock_if_missing`` an absent file gives the two mock
    rows (opt-in; the reference writes them to disk)."""
    if not _exists(spark, path):
        if not mock_if_missing:
            raise FileNotFoundError(path)
        return spark.createDataFrame(list(MOCK_USER_ROWS),
                                     "User_ID long, User_Job_Title string, User_Job_Description string")
    df = read_delimited(spark, path, ["User_ID", "User_Job_Title", "User_Job_Description"], sep=",")
    return fill_blank(df.withColumn("User_ID", F.col("User_ID").try_cast("long")))
