"""Shared folders for intermediate tables, table reading and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only a local master without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither repeat its work nor depend on executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The intermediate folders made so far."""
    return list(_MADE)


def release(spark: SparkSession, folders: list[str] | None = None) -> int:
    """Delete intermediate folders, all that were made so far or those given (results that were not written yet need them)."""
    jvm, gone = spark.sparkContext._jvm, 0
    for name in made() if folders is None else folders:
        if name in _MADE:
            _MADE.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def file_system(uri: str):
    """The pyarrow file system and the path inside it, for tasks that write or read plain files in a shared folder."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), str(PurePosixPath(uri))
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about most_bytes at most (a longer text stands alone)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def crc32_mod(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo a number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
