"""Exact medians per group, also when one group holds a large part of the data.

Spark's ``median`` keeps all distinct values of a group in one aggregation buffer.  That is right for
ordinary groups.  A group with more than ``small_group`` values is narrowed down first: every round
counts values in ``bins`` equal-width bins of the group's current range (a map-side combined count) and
keeps only the range holding the two middle ranks, until what is left is small.  Each round divides the
range by ``bins``; ranges that shrink to one value are finished.  No value is dropped or estimated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL_GROUP = 2_000_000


def to_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return (doubles.unpivot(list(keys), list(cols), "feature", "value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def exact_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  small_group: int = SMALL_GROUP, bins: int = 4096) -> DataFrame:
    """(keys..., feature, median) for every group with at least one value."""
    long = to_long(df, keys, cols)
    gk = [*keys, "feature"]
    stats = long.groupBy(*gk).agg(F.count("value").alias("n"), F.min("value").alias("lo"),
                                  F.max("value").alias("hi"))
    # at most (number of values / small_group) groups can be hot, so this list is short
    hot = stats.filter(F.col("n") > small_group).collect()
    if not hot:
        return long.groupBy(*gk).agg(F.median("value").alias("median"))
    spark = df.sparkSession
    schema = ", ".join([f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in gk]
                       + ["n bigint", "lo double", "hi double", "below bigint"])
    state = [(*[r[k] for k in gk], r["n"], r["lo"], r["hi"], 0) for r in hot]
    hot_keys = spark.createDataFrame(state, schema).select(*gk)
    cold = long.join(F.broadcast(hot_keys), gk, "left_anti")
    result = cold.groupBy(*gk).agg(F.median("value").alias("median"))

    g = len(gk)
    while state:
        done = [s for s in state if s[g + 1] == s[g + 2]]
        if done:
            result = result.unionByName(
                spark.createDataFrame([(*s[:g], s[g + 1]) for s in done],
                                      ", ".join([f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in gk]
                                                + ["median double"])))
        state = [s for s in state if s[g + 1] != s[g + 2]]
        if not state:
            break
        st = F.broadcast(spark.createDataFrame(state, schema))
        inside = long.join(st, gk).filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        # lo/2 and hi/2 keep the width finite for ranges near the ends of the double range
        pos = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        binned = (inside.withColumn("bin", F.least(F.floor(pos * bins), F.lit(bins - 1)))
                  .groupBy(*gk, "n", "below", "bin")
                  .agg(F.count("value").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi")))
        # one row per bin: at most `bins` rows per group
        w = Window.partitionBy(*gk).orderBy("bin")
        cum = binned.withColumn("start", F.col("below") + F.sum("c").over(w) - F.col("c"))
        k1, k2 = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        end = F.col("start") + F.col("c")
        holds = ((k1 >= F.col("start")) & (k1 < end)) | ((k2 >= F.col("start")) & (k2 < end))
        narrowed = (cum.filter(holds).groupBy(*gk, "n")
                    .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("start").alias("below"),
                         F.sum("c").alias("left")).collect())
        small = [r for r in narrowed if r["left"] <= small_group]
        if small:
            result = result.unionByName(_pick(long, spark, schema, gk, small))
        state = [(*[r[k] for k in gk], r["n"], r["lo"], r["hi"], r["below"])
                 for r in narrowed if r["left"] > small_group]
    return result


def _pick(long, spark, schema, gk, rows):
    """Median of groups whose remaining range holds few values."""
    st = spark.createDataFrame([(*[r[k] for k in gk], r["n"], r["lo"], r["hi"], r["below"]) for r in rows], schema)
    inside = (long.join(F.broadcast(st), gk)
              .filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))))
    rank = F.col("below") + F.row_number().over(Window.partitionBy(*gk).orderBy("value")) - 1
    middle = (rank == F.floor((F.col("n") - 1) / 2)) | (rank == F.floor(F.col("n") / 2))
    return inside.withColumn("hit", middle).filter("hit").groupBy(*gk).agg(F.avg("value").alias("median"))
