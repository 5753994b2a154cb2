"""Sector, flag and keyword tables joined to securities and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lookups as L


def join_keywords(names: DataFrame, column: str = "name") -> DataFrame:
    """Every weighted sector keyword that occurs in a name, one row per hit.

    The keyword table is a literal array filtered per name, so the substring join is row-local.
    """
    rows = ", ".join(f"named_struct('ord', {o}, 'sector', {L.sql_literal(s)}, 'weight', {w}, 'keyword', {L.sql_literal(k)})"
                     for o, s, w, k in L.TABLES["sector_keyword"][1])
    up = F.upper(column)
    with_up = names.withColumn("_u", up)
    hits = F.filter(F.expr(f"array({rows})"), lambda k: F.contains(F.col("_u"), k["keyword"]))
    return (with_up.select(column, F.explode(hits).alias("k"))
            .select(column, "k.ord", "k.sector", "k.weight", "k.keyword"))


def map_provider_sector(df: DataFrame, provider_sector: str, industry: str) -> DataFrame:
    """House sector: the provider's sector mapped (or kept as it is), else by words in the industry."""
    lk = F.broadcast(L.lookup(df.sparkSession, "provider_sector")
                     .select(F.col("provider_sector").alias("_ps"), F.col("sector").alias("_mapped")))
    given = F.when(F.col(provider_sector) != "", F.col(provider_sector))
    return df.join(lk, F.col(provider_sector) == F.col("_ps"), "left").select(
        *df.columns, F.coalesce("_mapped", given, C.industry_sector(F.col(industry))).alias("house_sector"))


def map_exchange_sector(df: DataFrame, exchange_sector: str) -> DataFrame:
    lk = F.broadcast(L.lookup(df.sparkSession, "exchange_sector")
                     .select(F.col("exchange_sector").alias("_es"), F.col("sector").alias("_mapped")))
    return df.join(lk, F.upper(exchange_sector) == F.col("_es"), "left").select(
        *df.columns, F.coalesce("_mapped", F.col(exchange_sector)).alias("exchange_house_sector"))


def industry_flags(df: DataFrame) -> DataFrame:
    """One row per risk flag of the row's sector (rows of sectors without flags give none)."""
    flags = (L.lookup(df.sparkSession, "industry_risk").groupBy("sector")
             .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "level")))).alias("flags")))
    return df.join(F.broadcast(flags), "sector").select(*df.columns, F.explode("flags").alias("flag", "level"))
