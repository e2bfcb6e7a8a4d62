"""KB vector cache: Parquet versions per model, published by a manifest.

The cache key follows the reference's rule: '/', '\\' and ' ' become '_', and
only the last path part is kept (so, as there, an absolute path becomes one
long name: '/' is replaced before the split). Writing refuses to overwrite
unless asked (the reference prompts); reading a missing model raises an error
naming the build step and checks the stored row count.

Under ``root/model=<key>`` every write puts its rows in a folder of its own,
counts them, and then creates the next numbered manifest, a file that may be
created only once. Readers take the newest whole manifest: they see all of a
version or none of it, whatever happens to a writer; of two writers that start
from the same version one creates the manifest and the other gets an error.
Earlier versions stay for those who read them until ``drop_old_versions``.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxomatch.sources.tables import _exists


class PublishedMeanwhile(FileExistsError):
    """Another writer published a version first."""


def cache_key(model_name: str) -> str:
    safe = str(model_name).replace("/", "_").replace("\\", "_").replace(" ", "_")
    return safe.rsplit("/", 1)[-1]


def _folder(root: str, model_name: str) -> str:
    return f"{root.rstrip('/')}/model={cache_key(model_name)}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    if not _exists(spark, f"{folder}/_manifests"):
        return []
    fs, p = _fs(spark, f"{folder}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, folder: str, version: int) -> dict | None:
    """None if its writer has not finished it."""
    fs, p = _fs(spark, f"{folder}/_manifests/{version:08d}.json")
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        return json.loads(reader.readLine() or "")
    except ValueError:
        return None
    finally:
        reader.close()


def newest_version(spark: SparkSession, root: str, model_name: str) -> tuple[int, dict] | None:
    """(number, manifest) of the newest published version."""
    folder = _folder(root, model_name)
    for version in reversed(_manifests(spark, folder)):
        found = _manifest(spark, folder, version)
        if found:
            return version, found
    return None


def _create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file unless it exists. HDFS does so atomically; on a local file
    system the operating system does."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            handle = os.open(p.toUri().getPath(), os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def stage_vectors(kb_vectors: DataFrame, root: str, model_name: str, kb_path: str = "") -> dict:
    """Write the rows into a folder that no manifest names yet and return the
    manifest that would publish them."""
    spark = kb_vectors.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    path = f"{_folder(root, model_name)}/{data}"
    kb_vectors.write.parquet(path)
    return {"data": data, "kb_rows": spark.read.parquet(path).count(), "kb_path": kb_path, "model_name": str(model_name),
            "created_at": _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")}


def publish(spark: SparkSession, root: str, model_name: str, staged: dict, after: int) -> int:
    """Make ``staged`` the version that follows ``after`` (0: none). Its folder
    is deleted and an error raised if another writer was first."""
    folder = _folder(root, model_name)
    if not _create_once(spark, f"{folder}/_manifests/{after + 1:08d}.json", json.dumps(staged) + "\n"):
        fs, p = _fs(spark, f"{folder}/{staged['data']}")
        fs.delete(p, True)
        raise PublishedMeanwhile(f"version {after + 1} of the vector cache at {folder} was published by another writer")
    return after + 1


def write_vector_cache(kb_vectors: DataFrame, root: str, model_name: str, overwrite: bool = False,
                       kb_path: str = "") -> str:
    """Write ``kb_vectors`` (code + vec_* columns) and publish them as the next
    version for the model. Returns the model's folder."""
    spark = kb_vectors.sparkSession
    folder = _folder(root, model_name)
    if newest_version(spark, root, model_name) and not overwrite:
        raise FileExistsError(f"vector cache for {model_name!r} exists at {folder}; pass overwrite=True")
    after = max(_manifests(spark, folder), default=0)  # an unfinished manifest keeps its number
    publish(spark, root, model_name, stage_vectors(kb_vectors, root, model_name, kb_path), after)
    return folder


def read_vector_cache(spark: SparkSession, root: str, model_name: str, check_rows: bool = True) -> DataFrame:
    """The newest version, with its row count and origin on every row."""
    folder = _folder(root, model_name)
    found = newest_version(spark, root, model_name)
    if found is None:
        raise FileNotFoundError(f"vector cache not found at {folder}; build it with write_vector_cache first")
    manifest = found[1]
    df = spark.read.parquet(f"{folder}/{manifest['data']}")
    if check_rows and (n := df.count()) != manifest["kb_rows"]:
        raise ValueError(f"vector cache {folder} holds {n} rows, expected {manifest['kb_rows']}")
    return df.select("*", F.lit(manifest["kb_rows"]).cast("long").alias("kb_rows"), *[F.lit(manifest[k]).alias(k) for k in ("kb_path", "model_name", "created_at")])


def drop_old_versions(spark: SparkSession, root: str, model_name: str) -> int:
    """Delete the folders of rows that the newest version does not name, those of
    ended writers included; call it when nobody reads or writes the model.
    Returns their number."""
    folder = _folder(root, model_name)
    found = newest_version(spark, root, model_name)
    if found is None:
        return 0
    fs, p = _fs(spark, folder)
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("data-") and s.getPath().getName() != found[1]["data"]]
    for path in old:
        fs.delete(path, True)
    return len(old)
