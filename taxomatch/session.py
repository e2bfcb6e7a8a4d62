"""Session helpers: a local session for tests and a shared scratch folder.

On a cluster the session comes from the launcher and ``spark.checkpoint.dir``
names a shared folder; we only read it. A private folder is created only when
the setting is absent (local runs and tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "taxomatch") -> SparkSession:
    builder = (
        SparkSession.builder.master(master or os.environ.get("TAXOMATCH_MASTER", "local[*]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TAXOMATCH_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """One machine: the driver's folders are the executors' folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a local session gets one of its own,
    deleted when the process ends; on a cluster the setting must be there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="taxomatch-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_WRITTEN: dict[str, list[str]] = {}


def delete_scratch(spark: SparkSession) -> int:
    """Delete the tables that this application has written to the shared
    folder, once no frame that reads them is needed any more. Returns their
    number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``taxomatch`` importable in Python workers (once per application):
    the package is zipped on the driver and added with ``addPyFile``, the
    usual way to ship library code with a job."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import taxomatch

    pkg = os.path.dirname(os.path.abspath(taxomatch.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="taxomatch-pkg-"), "taxomatch.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if not sc.master.startswith("local"):  # local-cluster workers fetch it from the driver
        # on a cluster, executors fetch the zip from the shared checkpoint folder
        shared = f"{scratch_dir(spark, '_pkg')}/taxomatch.zip"
        jvm = sc._jvm
        dst = jvm.org.apache.hadoop.fs.Path(shared)
        dst.getFileSystem(sc._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(out), dst)
        out = shared
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def reliable_checkpoint(df):
    """Cut lineage into ``spark.checkpoint.dir`` computing the plan once:
    a reliable checkpoint re-runs the plan in a second job unless the data is
    persisted first, so persist, checkpoint, then release the cache."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def spread_input(df, path: str, min_bytes: int = 1 << 20):
    """Round-robin an input that arrives in fewer partitions than the default
    parallelism (e.g. one large single-row-group file) so per-row work uses
    every core. Small inputs and inputs that already come in many files (the
    cluster case) are returned unchanged. Round-robin is deterministic on
    retry (rows are sorted before the repartition)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    want = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    jvm = sc._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return df.repartition(want) if size >= min_bytes else df


def bounded_broadcast(df, max_bytes: int = 64 << 20):
    """Broadcast hint only if the rows, written out as text, stay within
    ``max_bytes``; above it Spark plans a shuffle join instead. The input is
    computed once: it is cached for the check and read from there."""
    from pyspark.sql import functions as F

    small = reliable_checkpoint(df)
    size = small.select(F.sum(F.octet_length(F.to_json(F.struct(*small.columns))))).first()[0]
    return F.broadcast(small) if (size or 0) <= max_bytes else small
