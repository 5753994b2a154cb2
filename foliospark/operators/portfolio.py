"""Per-portfolio totals, shares, top holdings and concentration.

Totals come from grouped sums (combined before the shuffle), never from a window over the holdings of a
portfolio, so a portfolio with a third of all rows costs no more than others.  Top-k rankings filter on
``row_number() <= k``: Spark then keeps k rows per portfolio in every map task before shuffling
(WindowGroupLimit in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import skew


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def portfolio_summary(h: DataFrame) -> DataFrame:
    """Value, invested amount, profit and loss, holdings per portfolio."""
    t = h.groupBy("portfolio_id").agg(
        F.sum("value").alias("v"), F.sum("invested").alias("i"), F.count(F.lit(1)).alias("holdings"))
    return t.select("portfolio_id", F.round("v", 2).alias("total_value"), F.round("i", 2).alias("total_invested"),
                    F.round(F.col("v") - F.col("i"), 2).alias("total_pnl"),
                    F.round(F.when(F.col("i") > 0, (F.col("v") - F.col("i")) / F.col("i") * 100).otherwise(0.0), 4)
                    .alias("pnl_pct"), "holdings")


def totals(h: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """portfolio_id, total_value, n_rows and further aggregates: the summary that ``weights`` attaches."""
    return h.groupBy("portfolio_id").agg(
        F.sum("value").alias("total_value"), F.count(F.lit(1)).alias("n_rows"),
        *[c.alias(n) for n, c in (extra or {}).items()])


def weights(h: DataFrame, extra: dict[str, Column] | None = None, hot_rows: int = skew.HOT_ROWS, of: DataFrame | None = None) -> DataFrame:
    """Add ``total_value`` and ``weight`` (fraction of the portfolio), and totals asked for in ``extra``.

    ``of``: the holdings whose values count, where ``h`` is drawn from them; ``extra`` is always summed up over ``h``.
    """
    t = totals(h, extra) if of is None else totals(of)
    if of is not None and extra:
        more = h.groupBy(F.col("portfolio_id").alias("_of")).agg(*[c.alias(n) for n, c in extra.items()])
        t = t.join(more, F.col("portfolio_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    out = skew.attach(h, t, ["portfolio_id"], ["holding_id"], hot_rows=hot_rows)
    return out.withColumn("weight", F.when(F.col("total_value") > 0, F.col("value") / F.col("total_value")).otherwise(0.0))


def top_holdings(h: DataFrame, k: int) -> DataFrame:
    """The k largest holdings per portfolio with ``rn`` (1 = largest; ties by holding id)."""
    w = Window.partitionBy("portfolio_id").orderBy(F.desc("value"), "holding_id")
    return h.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def top_with_weight(h: DataFrame, k: int = 5) -> DataFrame:
    top = top_holdings(h, k).select("portfolio_id", "rn", "holding_id", "stock_name", "value")
    return (top.join(totals(h), "portfolio_id")
            .select("portfolio_id", "rn", "holding_id", "stock_name", F.round("value", 2).alias("value"),
                    F.round(F.col("value") / F.col("total_value") * 100, 4).alias("weight_pct")))


def top_plus_others(h: DataFrame, k: int = 8) -> DataFrame:
    """The k largest holdings and one Others row (total less the top k) when there are more."""
    top = (top_holdings(h, k)
           .select("portfolio_id", "rn", "holding_id", "stock_name", "value"))
    head = top.groupBy("portfolio_id").agg(F.sum("value").alias("head_value"), F.count(F.lit(1)).alias("head_n"))
    t = totals(h)
    shown = top.join(t, "portfolio_id")
    others = (head.join(t, "portfolio_id").filter(F.col("n_rows") > F.col("head_n"))
              .select("portfolio_id", F.lit(k + 1).alias("rn"), F.lit("").alias("holding_id"),
                      F.lit("Others").alias("stock_name"),
                      (F.col("total_value") - F.col("head_value")).alias("value"), "total_value"))
    both = shown.select(*others.columns).unionByName(others)
    return both.select("portfolio_id", "rn", "holding_id", "stock_name", F.round("value", 2).alias("value"),
                       F.round(F.col("value") / F.col("total_value") * 100, 4).alias("percentage"))


def concentration(h: DataFrame) -> DataFrame:
    """Largest holding, top-5 share, sector HHI and the warnings drawn from them."""
    top = top_holdings(h, 5).groupBy("portfolio_id").agg(F.max("value").alias("mx"), F.sum("value").alias("t5"))
    by_sector = h.groupBy("portfolio_id", "sector").agg(F.sum("value").alias("v"))
    tot = by_sector.groupBy("portfolio_id").agg(F.sum("v").alias("tv"), F.sum(F.col("v") * F.col("v")).alias("sq"))
    x = (top.join(tot, "portfolio_id").filter("tv > 0")
         .select("portfolio_id", F.round(F.col("mx") / F.col("tv") * 100, 4).alias("max_holding_pct"),
                 F.round(F.col("t5") / F.col("tv") * 100, 4).alias("top5_pct"),
                 F.round(F.col("sq") / (F.col("tv") * F.col("tv")) * 10000, 2).alias("sector_hhi")))
    return x.select(
        "*", (F.col("max_holding_pct") > 25).alias("single_stock_warning"),
        (F.col("sector_hhi") > 2500).alias("sector_warning"),
        F.when(F.col("top5_pct") > 50, "High concentration risk").when(F.col("top5_pct") > 30, "Moderate concentration")
        .otherwise("Well diversified").alias("top5_band"),
        R.hhi_grade(F.col("sector_hhi")).alias("hhi_grade"))


def risk_components(h: DataFrame) -> DataFrame:
    """Concentration penalty, diversification benefit and sector risk (percent points)."""
    s = h.groupBy("portfolio_id", "sector").agg(
        F.sum("value").alias("v"), F.sum(F.col("value") * F.col("value")).alias("sq"), F.count(F.lit(1)).alias("n"))
    t = s.groupBy("portfolio_id").agg(F.sum("v").alias("tv"), F.sum("sq").alias("sq"), F.sum("n").alias("n"),
                                      F.max("v").alias("mx"))
    hhi = F.col("sq") / (F.col("tv") * F.col("tv"))
    share = F.col("mx") / F.col("tv")
    ok = F.col("tv") > 0
    return t.select(
        "portfolio_id",
        F.round(F.when(ok, F.least(F.greatest((hhi - 0.1) * 10, F.lit(0.0)), F.lit(5.0))).otherwise(0.0), 6)
        .alias("concentration_penalty"),
        F.when(F.col("n") >= 20, -2.0).when(F.col("n") >= 15, -1.5).when(F.col("n") >= 10, -1.0)
        .when(F.col("n") >= 5, -0.5).otherwise(0.0).alias("diversification_benefit"),
        F.when(ok & (share > 0.5), 3.0).when(ok & (share > 0.3), 2.0).otherwise(1.0).alias("sector_risk"))


def limit_breaches(h: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Holdings and sectors above the warning or critical weight of each risk profile."""
    names = ["concentration_warning", "concentration_critical", "sector_concentration_warning", "max_sector_exposure"]
    profiles = thresholds.groupBy("profile").pivot("name", names).agg(F.first("value")).collect()  # a risk profile is configuration
    limits = F.array(*[F.struct(F.lit(p["profile"]).alias("profile"), *[F.lit(p[n]).cast("double").alias(n) for n in names]) for p in profiles])
    def judge(df, grain, item, warn, crit):
        # a row only meets the profiles whose warning it exceeds
        j = df.withColumn("p", F.explode(F.filter(limits, lambda p: F.col("weight_pct") > p[warn])))
        return j.select("portfolio_id", "p.profile", F.lit(grain).alias("grain"), F.col(item).alias("item"),
                        F.round("weight_pct", 4).alias("weight_pct"),
                        F.when(F.col("weight_pct") > F.col("p")[crit], "critical").otherwise("warning").alias("status"))
    per_holding = (weights(h).withColumn("weight_pct", F.col("weight") * 100)
                   .select("portfolio_id", "holding_id", "weight_pct"))
    by_sector = h.groupBy("portfolio_id", "sector").agg(F.sum("value").alias("v"))
    per_sector = by_sector.withColumn(
        "weight_pct", F.col("v") / F.sum("v").over(Window.partitionBy("portfolio_id")) * 100)
    return judge(per_holding, "holding", "holding_id", "concentration_warning", "concentration_critical").unionByName(
        judge(per_sector, "sector", "sector", "sector_concentration_warning", "max_sector_exposure"))


def category_weights(h: DataFrame, categorize) -> DataFrame:
    """Weight per asset category and the HHI over categories."""
    by_name = h.groupBy("portfolio_id", "stock_name").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    named = skew.map_distinct(by_name, "stock_name", "category", categorize, ["portfolio_id"])
    c = named.groupBy("portfolio_id", "category").agg(F.sum("value").alias("v"), F.sum("n").alias("n"))
    w = Window.partitionBy("portfolio_id")
    c = c.withColumn("wt", F.col("v") / F.sum("v").over(w))
    return c.withColumn("hhi", F.sum(F.col("wt") * F.col("wt")).over(w))


def sector_mix_detail(h: DataFrame, market: DataFrame) -> DataFrame:
    """(portfolio, sector, cap category) values with shares: market data where known, else keywords.

    ``market`` holds one row per security: security_id, market_sector, cap_category.
    """
    from ..functions import classify as C
    j = skew.join_dimension(h, market, "security_id", ["holding_id"])
    known = F.col("market_sector").isNotNull()
    by_name = j.groupBy("portfolio_id", "stock_name", "market_sector",
                        F.when(known, F.coalesce("cap_category", F.lit("Unknown Cap"))).otherwise("Unknown Cap").alias("cap_category")
                        ).agg(F.sum(positive(F.col("value"))).alias("value"), F.count_if(F.col("value") > 0).alias("n"))
    est = skew.map_distinct(by_name, "stock_name", "word_sector", C.infer_sector_simple, ["portfolio_id", "market_sector"])
    s = est.select("portfolio_id", F.coalesce("market_sector", "word_sector").alias("sector"), "cap_category",
                   F.when(F.col("market_sector").isNotNull(), F.col("n")).otherwise(0).alias("live"),
                   F.when(F.col("market_sector").isNull(), F.col("n")).otherwise(0).alias("estimated"), "value", "n")
    g = s.groupBy("portfolio_id", "sector", "cap_category").agg(
        F.sum("value").alias("value"), F.sum("n").alias("n"), F.sum("live").alias("live"),
        F.sum("estimated").alias("estimated")).filter("value > 0")
    ws, wp = Window.partitionBy("portfolio_id", "sector"), Window.partitionBy("portfolio_id")
    return g.select("portfolio_id", "sector", "cap_category", F.round("value", 2).alias("cap_value"),
                    F.round(F.col("value") / F.sum("value").over(ws), 6).alias("cap_share"),
                    F.round(F.sum("value").over(ws) / F.sum("value").over(wp), 6).alias("sector_weight"),
                    F.sum("n").over(ws).alias("sector_count"), F.sum("live").over(ws).alias("live"),
                    F.sum("estimated").over(ws).alias("estimated"))


def sector_members(h: DataFrame, sector: str = "sector") -> DataFrame:
    """The stocks behind each sector as rows (a list per sector could be as long as the table)."""
    return h.groupBy("portfolio_id", sector, "stock_name").agg(
        F.count(F.lit(1)).alias("holdings"), F.round(F.sum("value"), 2).alias("value"))


def distinct_sectors(h: DataFrame) -> DataFrame:
    return h.select("portfolio_id", "sector").distinct()


