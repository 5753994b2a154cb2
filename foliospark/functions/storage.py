"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="foliospark-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_MADE: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession) -> int:
    """Delete the intermediate folders made so far; results that are not written yet still need them."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def file_system(uri: str):
    """The pyarrow file system and the path inside it, for tasks that write plain files to the shared folder."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: survives the loss of executors, unlike a cache."""
    shared_dir(df.sparkSession)
    path = fresh_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
