"""Provider rows, snapshots, price series and value at risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lookups as L
from ..functions import ratings as R
from ..functions import skew
from ..functions.storage import cut_lineage


# provider rows ---------------------------------------------------------------------------------
def merge_provider_scores(rows: DataFrame) -> DataFrame:
    """Each provider's raw row to e, s, g, overall on 0..100; rows without a usable score go.

    yahoo: risk scale turned round, overall else mean of pillars, blank or zero pillars 50.
    finnhub: needs an environment score, other blanks 0. rapidapi: mean of pillars, all-zero rows go.
    fmp: overall else mean of pillars, zero overall goes.
    """
    is_ = lambda p: F.col("provider") == p
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ye, ys, yg = (R.msci_to_100(F.col(c)) for c in ("raw_e", "raw_s", "raw_g"))
    filled = lambda c: F.when(c != 0, c)
    y_all = F.coalesce(R.msci_to_100(F.col("raw_total")), (filled(ye) + filled(ys) + filled(yg)) / 3)
    e0, s0, g0 = zero("raw_e"), zero("raw_s"), zero("raw_g")
    mean0 = (e0 + s0 + g0) / 3
    any0 = (e0 != 0) | (s0 != 0) | (g0 != 0)
    fmp_all = F.when(zero("raw_total") != 0, F.col("raw_total")).when(any0, mean0).otherwise(0.0)
    overall = (F.when(is_("yahoo"), y_all)
               .when(is_("finnhub"), F.when(F.col("raw_e").isNotNull(), zero("raw_total")))
               .when(is_("rapidapi"), F.when(any0, mean0))
               .when(is_("fmp"), F.when(fmp_all != 0, fmp_all)))
    pillar = lambda y, z: F.when(is_("yahoo"), F.coalesce(filled(y), F.lit(50.0))).otherwise(z)
    return rows.select("ticker", "provider", "fact_id", "fetch_ts", pillar(ye, e0).alias("e"), pillar(ys, s0).alias("s"),
                       pillar(yg, g0).alias("g"), overall.alias("overall")).filter("overall IS NOT NULL")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Map tasks send on one row per key (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_snapshot(snap: DataFrame) -> DataFrame:
    return first_per_key(snap, ["ticker"], [F.desc("fetch_ts"), F.asc("provider"), F.desc("fact_id")])


def fresh_snapshot(snap: DataFrame, as_of: str, max_days: int) -> DataFrame:
    """Each ticker's latest row, if it is at most ``max_days`` old on ``as_of`` (a parameter, not the clock)."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("fetch_ts").cast("date"))
    return latest_snapshot(snap).filter(age <= max_days)


def priority_of(provider: Column, order: Sequence[str]) -> Column:
    out = F
    for i, p in enumerate(order):
        out = out.when(provider == p, F.lit(i))
    return out.otherwise(F.lit(len(order)))


def provider_fallback(symbols: DataFrame, facts: DataFrame, order: Sequence[str]) -> DataFrame:
    """First usable fact per symbol by provider order, else keyword classification of the name.

    ``symbols``: symbol, name. ``facts``: symbol, provider, ok, market_cap, sector, data_quality, fetch_ts.
    """
    ranked = facts.filter("ok").withColumn("_p", priority_of(F.col("provider"), order))
    best = first_per_key(ranked, ["symbol"], [F.asc("_p"), F.desc("fetch_ts"), F.asc("market_cap")]).select(
        "symbol", "provider", "market_cap", "sector", "data_quality")
    j = symbols.join(best, "symbol", "left")
    missing = F.col("provider").isNull()
    return j.select(
        "symbol", "name", F.coalesce("sector", F.when(missing, C.infer_sector_count(F.col("name")))).alias("sector"),
        F.coalesce("market_cap", F.lit(0.0)).alias("market_cap"),
        F.when(missing, "Unknown Cap").otherwise(R.cap_class_usd(F.col("market_cap"))).alias("cap_category"),
        F.coalesce("provider", F.lit("Fallback Classifier")).alias("provider"),
        F.coalesce("data_quality", F.lit("Low")).alias("data_quality"))


def quality_summary(market: DataFrame) -> DataFrame:
    q = F.col("data_quality")
    return market.agg(
        F.count(F.lit(1)).alias("total_symbols"), F.count_if(q == "High").alias("high_quality"),
        F.count_if(q == "Medium").alias("medium_quality"),
        F.count_if(~q.isin("High", "Medium")).alias("low_quality"),
        F.concat_ws(",", F.array_sort(F.collect_set("provider"))).alias("providers_used"))


def esg_trend(snap: DataFrame, as_of: str, period_days: int, periods: int = 4) -> DataFrame:
    """Score known at the end of each period, change over all of them and its direction.

    One pass: a conditional max_by per period.
    """
    cut = lambda i: F.date_add(F.lit(as_of).cast("date"), -period_days * i)
    known = [F.max_by(F.when(F.col("fetch_ts").cast("date") <= cut(i), F.col("overall")),
                      F.when(F.col("fetch_ts").cast("date") <= cut(i), F.struct("fetch_ts", "fact_id"))).alias(f"score_{i}")
             for i in range(periods)]
    g = snap.groupBy("ticker").agg(*known)
    change = F.col("score_0") - F.col(f"score_{periods - 1}")
    return g.select("ticker", *[F.round(f"score_{i}", 4).alias(f"score_{i}") for i in range(periods)],
                    F.round(change, 4).alias("change"),
                    F.when(change.isNull(), "No Data").when(F.round(change, 9) > 0, "Improving").otherwise("Declining")
                    .alias("direction"))


# price series ----------------------------------------------------------------------------------
def daily_returns(prices: DataFrame) -> DataFrame:
    """Return on the day before. ``prices`` has one row per symbol and day, so a series is never longer
    than the calendar however many trades a symbol has."""
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("dt"))
    return prices.withColumn("ret", F.col("close") / prev - 1)


def price_features(prices: DataFrame) -> DataFrame:
    """vol_30d, ret_1m and first-to-last return per symbol, from one sort of each series."""
    w = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    x = prices.select("symbol", "close", F.row_number().over(w).alias("back"),
                      (F.col("close") / F.lead("close").over(w) - 1).alias("ret"))
    g = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.stddev_samp("ret").alias("std_all"), F.sum("ret").alias("sum_all"),
        F.stddev_samp(F.when(F.col("back") <= 30, F.col("ret"))).alias("std_30"),
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("last"),
        F.max(F.when(F.col("back") == 22, F.col("close"))).alias("month_ago"),
        F.max_by("close", "back").alias("first"))
    return g.select(
        "symbol", "days",
        F.when(F.col("days") > 30, F.col("std_30")).when(F.col("days") < 30, F.col("std_all")).alias("vol_30d"),
        F.when(F.col("days") >= 22, F.col("last") / F.col("month_ago") - 1).otherwise(F.col("sum_all")).alias("ret_1m"),
        (F.col("last") / F.col("first") - 1).alias("ret_first_last"))


# value at risk ---------------------------------------------------------------------------------
def parametric_var(h: DataFrame, z: float = 1.645) -> DataFrame:
    r = (F.col("price") - F.col("avg_cost")) / F.col("avg_cost")
    g = h.groupBy("portfolio_id").agg(F.stddev_samp(r).alias("sd"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("tv"))
    vol = F.col("sd") * F.sqrt("n")
    return g.select("portfolio_id", F.round(vol, 6).alias("volatility"),
                    F.round(F.col("tv") * vol * z, 2).alias("var_95"),
                    F.round(vol * z * 100, 4).alias("max_loss_pct"))


def historical_var(h: DataFrame, prices: DataFrame) -> DataFrame:
    """5th and 1st percentile of daily portfolio returns times value.

    Holdings are summed to (portfolio, symbol) and brought together by portfolio before they meet the return series (only
    those of symbols held), so the days of a portfolio, many times its positions, are made and summed up where they are needed.
    The series of a portfolio has one row per day.  ``h``: portfolio_id, symbol, value.
    """
    tasks = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pos = cut_lineage(h.groupBy("portfolio_id", "symbol").agg(F.sum("value").alias("v")))
    held = prices.join(pos.select("symbol").distinct(), "symbol", "left_semi")
    # a series is one row per day; as an array it can be joined to a symbol held by very many portfolios
    # (2,000 series of 30 years are some 200 MB, the most that is broadcast)
    series = cut_lineage(daily_returns(held).filter("ret IS NOT NULL").groupBy("symbol")
                         .agg(F.collect_list(F.struct("dt", "ret")).alias("series")))  # counted, then joined
    together = pos.repartition(tasks, "portfolio_id")
    totals = together.groupBy("portfolio_id").agg(F.sum("v").alias("tv"))
    day = (skew.join_dimension(together, series, "symbol", ["portfolio_id"], max_rows=2_000)
           .select("portfolio_id", "v", F.explode("series").alias("x"))
           .groupBy("portfolio_id", F.col("x.dt").alias("dt")).agg(F.sum(F.col("x.ret") * F.col("v")).alias("gain"))
           .join(totals, "portfolio_id").withColumn("r", F.try_divide("gain", "tv")))
    g = day.groupBy("portfolio_id", "tv").agg(F.count(F.lit(1)).alias("days"), F.percentile("r", F.lit(0.05)).alias("p5"),
                                              F.percentile("r", F.lit(0.01)).alias("p1"))
    return g.select("portfolio_id", "days", F.round(F.abs(F.col("p5") * F.col("tv")), 2).alias("var_95"),
                    F.round(F.abs(F.col("p1") * F.col("tv")), 2).alias("var_99"))


# feature collection ----------------------------------------------------------------------------
def impute_by_sector(df: DataFrame) -> DataFrame:
    """Add proxy pillars px_e, px_s, px_g and px_total from the sector, moved by 10 for large and small caps."""
    lk = F.broadcast(L.lookup(df.sparkSession, "sector_esg_proxy_collect").select(
        F.col("sector").alias("_s"), F.col("e").alias("_e"), F.col("s").alias("_so"), F.col("g").alias("_g")))
    known = [r[0] for r in L.SECTOR_ESG_PROXY_COLLECT]
    key = F.when(F.col("sector").isin(known), F.col("sector")).otherwise("Other")
    cap = F.col("marketCap")
    adj = F.when(cap > 50e9, 10).when((cap < 5e9) & (cap != 0), -10).otherwise(0)
    j = df.withColumn("_key", key).join(lk, F.col("_key") == F.col("_s"))
    p = [R.clamp(F.col(c) + adj) for c in ("_e", "_so", "_g")]
    return j.select(*df.columns, p[0].alias("px_e"), p[1].alias("px_s"), p[2].alias("px_g"),
                    F.round((p[0] + p[1] + p[2]) / 3, 1).alias("px_total"))


def collect_features(basics: DataFrame, prices: DataFrame, esg_rows: DataFrame,
                     order: Sequence[str] = ("yahoo", "finnhub")) -> DataFrame:
    """Training rows: fundamentals, price features and the ESG label (provider, else sector proxy).

    ``basics``: symbol, company, sector, marketCap, trailingPE, beta. ``esg_rows``: symbol, provider,
    fetch_ts, fact_id, total_esg, environment_score, social_score, governance_score as the provider gave them.
    """
    some = F.coalesce("total_esg", "environment_score", "social_score", "governance_score").isNotNull()
    ranked = esg_rows.filter(F.col("provider").isin(list(order)) & some).withColumn("_p", priority_of(F.col("provider"), order))
    label = first_per_key(ranked, ["symbol"], [F.asc("_p"), F.desc("fetch_ts"), F.desc("fact_id")]).select(
        "symbol", "provider", "total_esg", "environment_score", "social_score", "governance_score")
    feats = price_features(prices).select("symbol", "vol_30d", "ret_1m")
    j = impute_by_sector(basics).join(feats, "symbol", "left").join(label, "symbol", "left")
    imputed = F.col("provider").isNull()
    use = lambda c, p: F.when(imputed, F.col(p)).otherwise(F.col(c)).alias(c)
    return j.select(
        "symbol", "company", "sector", "marketCap", "trailingPE", "beta", "vol_30d", "ret_1m",
        use("total_esg", "px_total"), use("environment_score", "px_e"), use("social_score", "px_s"),
        use("governance_score", "px_g"), F.coalesce("provider", F.lit("sector_proxy")).alias("source"),
        imputed.alias("imputed"),
        F.when(imputed, F.concat(F.lit("imputed_from_sector("), F.coalesce("sector", F.lit("Other")), F.lit(")")))
        .otherwise(F.col("provider")).alias("label_note"))
