"""Stream-static matching gives the batch result."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from taxomatch.functions.vectors import TUNED_WEIGHTS
from taxomatch.operators.match import MatchConfig, match, to_wide
from taxomatch.plans import standins as si
from taxomatch.streaming.match_stream import start_stream_match


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="taxomatch-stream-")
    src = f"{base}/in"
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    e.repartition(4).write.parquet(src)
    kb = si.vector_kb(spark, SF001)
    cfg = MatchConfig(weights=TUNED_WEIGHTS)

    def prep(b):
        return b.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))

    q = start_stream_match(spark, src, e.schema, kb, f"{base}/out", f"{base}/ckpt", cfg, prep, max_files=1)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{base}/out").drop("epoch")
    want = to_wide(match(prep(e), kb, cfg), "production")
    assert got.count() == want.count() == e.count()
    assert got.exceptAll(want).count() == 0
