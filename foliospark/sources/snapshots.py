"""Append-only snapshots with a compacted current table, so that the latest row per ticker does not need all history."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut_lineage
from ..operators.market import latest_snapshot
from .readers import SNAPSHOT_COLUMNS

BUCKETS = 256


class SnapshotStore:
    """Folders under one path: ``landed/batch=...`` per append, ``current/bucket=...`` with one row per ticker, and
    ``folded/<time>`` listing the batches that the current table covers.

    An append never rewrites anything, so appends may overlap with each other and with a compaction; a batch counts once its
    write has ended.  A compaction replaces only the buckets whose rows the new batches change, and lists these batches
    last: one that dies halfway is repeated by the next, as folding a row in again changes nothing.  One compaction runs at
    a time.  The names of batches are the only thing on the driver.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _names(self, folder: str, needs_end: bool = True) -> list[str]:
        """Names below a folder whose write has ended."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        done = lambda p: not needs_end or fs.exists(p.suffix("/_SUCCESS"))
        return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and done(s.getPath()))

    def append(self, df: DataFrame) -> str:
        """Land rows (missing scores are 0); the name of the batch."""
        name = f"batch={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in SNAPSHOT_COLUMNS}).write.parquet(f"{self.path}/landed/{name}")
        return name

    def pending(self) -> list[str]:
        """Batches that the current table does not cover."""
        folded = self._names("folded")
        covered = {r["batch"] for r in self.spark.read.parquet(*[f"{self.path}/folded/{n}" for n in folded]).collect()} if folded else set()
        return [b for b in self._names("landed") if b not in covered]

    def _landed(self, batches: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/landed/{b}" for b in batches])

    def _current(self) -> DataFrame | None:
        if not any(n.startswith("bucket=") for n in self._names("current", needs_end=False)):
            return None
        return self.spark.read.parquet(f"{self.path}/current")

    def _bucket(self):
        return F.pmod(F.xxhash64("ticker"), F.lit(self.buckets)).cast("int")

    def compact(self) -> int:
        """Fold all pending batches into the current table; the number of batches folded."""
        batches = self.pending()
        if not batches:
            return 0
        fresh = latest_snapshot(self._landed(batches)).withColumn("bucket", self._bucket())
        fresh, current = cut_lineage(fresh), self._current()
        if current is not None:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            before = current.filter(F.col("bucket").isin(touched))
            fresh = cut_lineage(latest_snapshot(fresh.unionByName(before, allowMissingColumns=True)))
            if set(fresh.columns) == set(before.columns):  # rows that are older, or folded in again, change nothing
                changed = fresh.exceptAll(before.select(*fresh.columns)).select("bucket").distinct().collect()
                fresh = fresh.filter(F.col("bucket").isin([r["bucket"] for r in changed]))
        (fresh.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "ticker").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/current"))
        mark = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        mark.coalesce(1).write.parquet(f"{self.path}/folded/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        return len(batches)

    def latest(self) -> DataFrame:
        """The newest row per ticker, from the current table and the batches after it; as ``latest_snapshot`` of all history."""
        current, batches = self._current(), self.pending()
        parts = ([current.drop("bucket")] if current is not None else []) + ([self._landed(batches)] if batches else [])
        if not parts:
            raise FileNotFoundError(f"no snapshots below {self.path}")
        return parts[0] if current is not None and not batches else latest_snapshot(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True))
