"""Run catalogue queries on Spark and their SQL on DuckDB and compare
(row count, column names, order-insensitive values). Usage:

    python tests/oracle_check.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if isinstance(v, Decimal):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [cols[i] for i in order], sorted(out, key=repr)


SPARK_FAMILY = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float",
                "float": "float", "string": "str", "boolean": "bool"}
DUCK_FAMILY = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int!", "SMALLINT": "int", "DOUBLE": "float",
               "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool"}


def _signed_zeros(rows):
    return sum(1 for r in rows for v in r if isinstance(v, float) and v == 0.0 and math.copysign(1, v) < 0)


def compare(spark, con, key, fn, sql, sf_dir, strict: bool = True):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_types = dict(df.dtypes)
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"ROWS {key:22s} spark={len(s_rows)} ({t1 - t0:.1f}s)", True
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_types = {c[0]: str(c[1]) for c in res.description}
    d_rows = res.fetchall()
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    ok = sc == dc and sr == dr
    notes = []
    if strict and sc == dc:
        for c in sc:
            a = SPARK_FAMILY.get(s_types[c], s_types[c])
            b = DUCK_FAMILY.get(d_types[c].split("(")[0], d_types[c])
            if a != b:
                notes.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
        zs, zd = _signed_zeros(sr), _signed_zeros(dr)
        if zs != zd:
            notes.append(f"signed zeros spark={zs} duck={zd}")
    if notes:
        ok = False
    msg = f"{'OK  ' if ok else 'DIFF'} {key:22s} spark={len(sr)} duck={len(dr)} ({t1 - t0:.1f}s)"
    if notes:
        msg += "\n   " + "; ".join(notes)
    if sc != dc:
        msg += f"\n   cols spark={sc}\n   cols duck ={dc}"
    elif sr != dr:
        ss, ds = set(sr), set(dr)
        a = [r for r in sr if r not in ds][:3]
        b = [r for r in dr if r not in ss][:3]
        msg += f"\n   spark-only {a}\n   duck-only  {b}"
    return msg, ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    from taxomatch.plans.catalogue import QUERIES
    from taxomatch.plans.oracle import oracle_sql
    from taxomatch.session import get_spark

    if os.environ.get("ORACLE_PLAIN_SESSION"):
        # the driver's kind of session: defaults (200 shuffle partitions, no checkpoint dir)
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark()
    con = duck(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for key, fn in QUERIES.items():
        if only and key not in only:
            continue
        try:
            msg, ok = compare(spark, con, key, fn, sqls.get(key), sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, ok = f"ERR  {key}: {type(e).__name__}: {str(e)[:800]}", False
        bad += not ok
        print(msg, flush=True)
    print(f"failed: {bad}")


if __name__ == "__main__":
    main()
