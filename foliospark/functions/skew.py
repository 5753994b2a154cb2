"""Joining per-key totals back to rows when one key may hold a large part of all rows.

``sum(x) OVER (PARTITION BY k)`` sends every row of a key to one task.  ``attach`` gives the same
result from a grouped summary (combined map-side, so a hot key costs one row per task) and a join
in which no key with more than ``HOT_ROWS`` rows is ever shuffled to a single task:

* hot keys (more than ``hot_rows`` rows) are broadcast.  There can be at most N / hot_rows of them,
  e.g. 200,000 for 10^12 rows, so the broadcast has a size bound whatever the key distribution;
* rows of hot keys are spread over ``SALTS`` artificial sub-keys in the ordinary join, where they
  need no partner; all other rows join on their key, whose group is below the limit.

Keys compare null-safely: rows without a key are a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut_lineage

HOT_ROWS = 5_000_000
SALTS = 4096
BROADCAST_ROWS = 200_000  # of a table shown to be small


def attach(fact: DataFrame, summary: DataFrame, keys: Sequence[str], spread: Sequence[str],
           count_col: str = "n_rows", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join ``summary`` (one row per key, with a row count) to ``fact``.

    ``spread`` names fact columns that differ between rows of one key; their hash is the salt, so a
    recomputed task puts every row where it was before.  The count column itself is not returned.
    """
    keys = list(keys)
    values = [c for c in summary.columns if c not in keys and c != count_col]
    packed = F.struct(*values)
    theirs = [F.col(k).alias(f"_key_{k}") for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    hot = summary.filter(F.col(count_col) > hot_rows).select(*theirs, packed.alias("_hot"))
    cold = summary.filter(F.col(count_col) <= hot_rows).select(*theirs, F.lit(0).alias("_zero"), packed.alias("_cold"))
    salt = F.when(F.col("_hot").isNotNull(),
                  F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    salted = fact.join(F.broadcast(hot), same, "left").select(*fact.columns, "_hot", salt.alias("_salt"))
    joined = salted.join(cold, same & (F.col("_salt") == F.col("_zero")), "left")
    return joined.select(*fact.columns,
                         *[F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values])


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is shown to be small, else as it is.

    For tables a caller supplies (benchmarks, custom scenarios): at most ``max_rows + 1`` rows are read to
    find out.  A larger table is joined by Spark's own choice, with adaptive skew handling.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``hot_rows`` rows, stored; null is a key like any other."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return cut_lineage(n.filter(F.col("n_rows") > hot_rows).select(key))


def join_dimension(fact: DataFrame, dim: DataFrame, key: str, spread: Sequence[str], max_rows: int = BROADCAST_ROWS,
                   hot_rows: int = HOT_ROWS, dim_rows: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Left join ``dim`` (one row per key) to ``fact``, whatever the size of dim and the skew of the key.

    A dimension shown to be small is broadcast.  A larger one is joined on the key as it is, so rows that lie together by the
    key already are not shuffled again; only if a key has more than ``hot_rows`` rows are these spread and their part of dim broadcast.
    ``dim_rows`` is its row count where the caller knows it (counting a derived table computes it once more), ``keys`` a table
    with about as many rows per key as ``fact`` that is cheaper to count; it decides on the spreading alone.
    """
    added = [c for c in dim.columns if c != key]
    if (dim.limit(max_rows + 1).count() if dim_rows is None else dim_rows) <= max_rows:
        return fact.join(F.broadcast(dim), key, "left").select(*fact.columns, *added)
    hot = hot_keys(fact if keys is None else keys, key, hot_rows)
    if hot.isEmpty():
        return fact.join(dim, key, "left").select(*fact.columns, *added)
    known = dim.select(F.col(key).alias("_key"), F.struct(*added).alias("_cold"))
    hot = hot.join(known, F.col(key) == F.col("_key"), "left").select(F.col(key).alias("_hot_key"), F.struct(F.col("_cold").alias("d")).alias("_hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    salted = fact.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left").select(*fact.columns, "_hot", salt.alias("_salt"))
    joined = salted.join(known.withColumn("_zero", F.lit(0)), (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    return joined.select(*fact.columns, *[F.coalesce(F.col("_hot.d")[v], F.col("_cold")[v]).alias(v) for v in added])


def map_distinct(df: DataFrame, column: str, out: str, fn, spread: Sequence[str],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out = fn(column)`` where ``fn`` is costly: it runs once per distinct value, not per row."""
    names = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(out, fn(F.col(column)))
    return attach(df, names, [column], spread, hot_rows=hot_rows)
