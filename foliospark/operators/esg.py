"""ESG scores of holdings and portfolios.

Scores are resolved once per security (a dimension table) and joined to holdings; portfolio results are
weighted sums grouped by portfolio, so no list of holdings is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import ratings as R
from ..functions import skew
from .portfolio import weights


def _by_portfolio():
    """Only used over one row per portfolio and sector or article."""
    return Window.partitionBy("portfolio_id")


# scores per security and holding -----------------------------------------------------------------
def read_company_scores(company: DataFrame) -> DataFrame:
    """Company database rows with 50 for every missing score."""
    fifty = lambda c: F.coalesce(F.col(c), F.lit(50.0)).alias(c)
    return company.select(F.upper(F.col("ticker").cast("string")).alias("ticker"), *[fifty(c) for c in ("e", "s", "g", "total")],
                          F.coalesce("tier", F.lit("Average")).alias("tier"))


def proxy_lookup(df: DataFrame, cap: Column, proxy_table: DataFrame | None = None) -> DataFrame:
    """Add px_e, px_s, px_g, px_overall and px_source from sector and cap band.

    A row of ``proxy_table`` (sector, market_cap_range, environmental_score, social_score,
    governance_score, overall_esg, data_source) for the sector, else for Other; without one, the sector
    default times the band's factor.
    """
    known = [r[0] for r in L.SECTOR_ESG_DEFAULT]
    band, factor = R.esg_cap_band(cap), R.esg_cap_factor(cap)
    base = F.broadcast(L.lookup(df.sparkSession, "sector_esg_default").select(
        F.col("sector").alias("_ds"), F.col("e").alias("_de"), F.col("s").alias("_dso"), F.col("g").alias("_dg")))
    key = F.when(F.col("sector").isin(known), F.col("sector")).otherwise("Other")
    j = df.withColumn("_band", band).withColumn("_f", factor).withColumn("_k", key).join(base, F.col("_k") == F.col("_ds"))
    e, s, g = (F.col(c) * F.col("_f") for c in ("_de", "_dso", "_dg"))
    o, src = (e + s + g) / 3, F.concat(F.lit("Sector Average ("), F.col("sector"), F.lit(")"))
    if proxy_table is not None:
        p = F.struct(F.col("environmental_score").alias("e"), F.col("social_score").alias("s"),
                     F.col("governance_score").alias("g"), F.col("overall_esg").alias("o"), F.col("data_source").alias("src"))
        side = skew.small_side(proxy_table)
        own = side.select(F.col("sector"), F.col("market_cap_range").alias("_band"), p.alias("_own"))
        oth = side.filter(F.col("sector") == "Other").select(F.col("market_cap_range").alias("_band"), p.alias("_oth"))
        j = j.join(own, ["sector", "_band"], "left").join(oth, "_band", "left").withColumn("_p", F.coalesce("_own", "_oth"))
        have = F.col("_p").isNotNull()
        e, s, g, o, src = (F.when(have, F.col("_p")[n]).otherwise(x) for n, x in
                           (("e", e), ("s", s), ("g", g), ("o", o), ("src", src)))
    return j.select(*df.columns, F.col("_band").alias("px_band"),
                    *[R.round_half_up(R.clamp(c), 2).alias(n) for c, n in
                      ((e, "px_e"), (s, "px_s"), (g, "px_g"), (o, "px_overall"))],
                    F.concat(src, F.lit(" (Proxy)")).alias("px_source"))


def resolve_esg_tier(securities: DataFrame, snapshot: DataFrame, company: DataFrame, predictions: DataFrame,
                     max_imputed: float = 0.45) -> DataFrame:
    """Best source per security: provider snapshot, company database, model prediction, else proxy.

    ``securities``: security_id, ticker, market_cap. ``snapshot`` and ``company`` are keyed by ticker,
    ``predictions`` by security_id; a prediction with more than ``max_imputed`` imputed inputs is not used.
    """
    snap = snapshot.select("ticker", F.struct("e", "s", "g").alias("_snap"))
    comp = company.select("ticker", F.struct("e", "s", "g").alias("_comp"))
    pred = predictions.filter(F.col("imputation_ratio") <= max_imputed).select(
        "security_id", "predicted", "imputation_ratio", F.struct(F.col("m_e").alias("e"), F.col("m_s").alias("s"),
                                                                 F.col("m_g").alias("g")).alias("_pred"))
    j = securities.join(pred, "security_id", "left").join(snap, "ticker", "left").join(comp, "ticker", "left")
    tier = (F.when(F.col("_snap").isNotNull(), "api").when(F.col("_comp").isNotNull(), "company")
            .when(F.col("_pred").isNotNull(), "model").otherwise("proxy"))
    used = F.coalesce("_snap", "_comp", "_pred")
    model = tier == "model"
    return j.select("security_id", "market_cap", tier.alias("tier"), used["e"].alias("e"), used["s"].alias("s"),
                    used["g"].alias("g"), F.when(model, F.col("predicted")).alias("predicted"),
                    F.when(model, F.col("imputation_ratio")).alias("imputation_ratio"))


def score_holdings(h: DataFrame, tiers: DataFrame, proxy_table: DataFrame | None = None,
                   security_rows: int | None = None, security_keys: DataFrame | None = None) -> DataFrame:
    """E, S, G, overall (2 digits), stars, label and source per holding.

    ``security_rows``: the number of rows of ``tiers``, one per security, if known.  ``security_keys``: see ``skew.join_dimension``.

    The overall score is weighted by sector; a model score without pillars stands by itself; the proxy
    uses the market cap, or the holding's value where the cap is unknown (``cap_known`` tells).
    """
    j = skew.join_dimension(h, tiers, "security_id", ["holding_id"], dim_rows=security_rows, keys=security_keys)
    j = j.withColumn("tier", F.coalesce("tier", F.lit("proxy")))
    j = proxy_lookup(j, F.coalesce("market_cap", "value"), proxy_table)
    w = F.broadcast(L.lookup(h.sparkSession, "sector_esg_weight"))
    j = j.join(w, "sector", "left")
    we, ws, wg = (F.coalesce(F.col(c), F.lit(x)) for c, x in zip(("we", "ws", "wg"), L.DEFAULT_ESG_WEIGHT))
    proxy = F.col("tier") == "proxy"
    e, s, g = (F.coalesce(F.col(c), F.col("predicted")) for c in "esg")
    own = F.col("e") * we + F.col("s") * ws + F.col("g") * wg
    overall = F.when(proxy, F.col("px_overall")).otherwise(R.round_half_up(F.coalesce(own, F.col("predicted")), 2))
    pick = lambda px, c, n: F.when(proxy, F.col(px)).otherwise(R.round_half_up(c, 2)).alias(n)
    x = j.select(*h.columns, "tier", "imputation_ratio", F.col("market_cap").isNotNull().alias("cap_known"),
                 pick("px_e", e, "env"), pick("px_s", s, "social"), pick("px_g", g, "gov"), overall.alias("overall"),
                 F.when(proxy, F.col("px_source")).when(F.col("tier") == "api", "Provider")
                 .when(F.col("tier") == "company", "BRSR/CDP Database").otherwise("ml_model").alias("data_source"))
    return (x.withColumn("stars", R.star_rating(F.col("overall"))).withColumn("label", R.rating_label(F.col("stars")))
            .withColumn("is_proxy", F.col("tier") == "proxy"))


# portfolio results ---------------------------------------------------------------------------------
def portfolio_esg(scored: DataFrame) -> DataFrame:
    """Value-weighted scores, stars, label, risk level and stress multiplier."""
    v = F.col("value")
    g = scored.filter("value > 0").groupBy("portfolio_id").agg(
        F.sum("value").alias("tv"), F.count(F.lit(1)).alias("total_holdings"),
        *[(F.sum(v * F.col(c)) / F.sum("value")).alias("w_" + c) for c in ("env", "social", "gov", "overall")])
    stars = R.star_rating(F.col("w_overall"))
    return g.select("portfolio_id", *[F.round("w_" + c, 1).alias(c) for c in ("env", "social", "gov", "overall")],
                    stars.alias("stars"), R.rating_label(stars).alias("label"),
                    R.esg_risk_level(F.round("w_overall", 1)).alias("risk_level"),
                    R.esg_risk_multiplier(F.col("w_overall")).alias("risk_multiplier"), "total_holdings",
                    F.round("tv", 2).alias("total_value"))


def portfolio_profile(portfolios: DataFrame, esg: DataFrame) -> DataFrame:
    """Every portfolio; those without a valued holding get the unrated record."""
    j = portfolios.join(esg, "portfolio_id", "left")
    fill = {"env": 0.0, "social": 0.0, "gov": 0.0, "overall": 0.0, "stars": 0, "label": "No Data",
            "risk_level": "Unable to assess", "risk_multiplier": 1.0, "total_holdings": 0, "total_value": 0.0}
    types = dict(esg.dtypes)
    return j.select("portfolio_id", *[F.coalesce(F.col(c), F.lit(x).cast(types[c])).alias(c) for c, x in fill.items()])


def esg_coverage(scored: DataFrame) -> DataFrame:
    rated = ~F.col("is_proxy")
    g = scored.filter("value > 0").groupBy("portfolio_id").agg(
        F.sum("value").alias("tv"), F.coalesce(F.sum(F.when(rated, F.col("value"))), F.lit(0.0)).alias("rv"),
        F.count_if(rated).alias("rated_holdings"), F.count_if("is_proxy").alias("unrated_holdings"),
        F.count_if(F.col("tier").isin("api", "company")).alias("api_data"),
        F.count_if(F.col("tier") == "model").alias("ml_predictions"), F.count(F.lit(1)).alias("n"))
    share = lambda c: F.round(F.col(c) / F.col("n") * 100, 4)
    return g.select("portfolio_id", F.round(R.clamp(F.col("rv") / F.col("tv") * 100), 1).alias("coverage_pct"),
                    "rated_holdings", "unrated_holdings", "api_data", "ml_predictions",
                    F.col("unrated_holdings").alias("sector_proxy"), share("api_data").alias("api_share"),
                    share("ml_predictions").alias("ml_share"), share("unrated_holdings").alias("proxy_share"))


def _weighted(scored: DataFrame) -> DataFrame:
    """The weight column is taken as it is when the holdings got it before they were scored."""
    return scored if "weight" in scored.columns else weights(scored)


def with_weight_pct(scored: DataFrame) -> DataFrame:
    """Holdings with weight_pct (2 digits)."""
    return _weighted(scored).withColumn("weight_pct", R.round_half_up(F.col("weight") * 100, 2))


def esg_sector_breakdown(scored: DataFrame) -> DataFrame:
    """Count, weight and plain mean scores per sector; names come from ``portfolio.sector_members``."""
    g = with_weight_pct(scored).groupBy("portfolio_id", "sector").agg(
        F.count(F.lit(1)).alias("count"), F.sum("weight_pct").alias("w"),
        *[F.avg(c).alias("a_" + c) for c in ("overall", "env", "social", "gov")])
    half = R.round_half_up
    return g.select("portfolio_id", "sector", "count", half(F.col("w"), 1).alias("total_weight"),
                    half(F.col("a_overall"), 1).alias("avg_esg_score"), half(F.col("a_env"), 1).alias("avg_env"),
                    half(F.col("a_social"), 1).alias("avg_social"), half(F.col("a_gov"), 1).alias("avg_gov"))


def rank_sectors(breakdown: DataFrame) -> DataFrame:
    w = _by_portfolio().orderBy(F.desc("avg_esg_score"), "sector")
    return breakdown.select("portfolio_id", "sector", "avg_esg_score", "total_weight", F.row_number().over(w).alias("rank"))


def esg_exposures(scored: DataFrame) -> DataFrame:
    """Risk messages: many low stars, many proxies, heavy sensitive sectors."""
    x = with_weight_pct(scored)
    sums = [F.coalesce(F.sum(F.when(F.col("sector") == s, F.col("weight_pct"))), F.lit(0.0)).alias(f"w{i}")
            for i, s in enumerate(L.SENSITIVE_SECTORS)]
    g = x.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stars") <= 2).alias("low"),
                                      F.count_if("is_proxy").alias("px"), *sums)
    pct = lambda c: R.amount(R.round_half_up(F.col(c) / F.col("n") * 100, 0), 0)
    msgs = [F.when(F.col("low") / F.col("n") > 0.3,
                   F.concat(F.lit("High Risk: "), F.col("low").cast("string"), F.lit(" holdings ("), pct("low"), F.lit("%) rated 1 or 2 stars"))),
            F.when(F.col("px") / F.col("n") > 0.5,
                   F.concat(F.lit("Data Risk: "), F.col("px").cast("string"), F.lit(" holdings ("), pct("px"), F.lit("%) using estimated ESG scores")))]
    msgs += [F.when(F.round(f"w{i}", 6) > 30, F.concat(F.lit("Sector Risk: High exposure ("),
                                                       R.amount(R.round_half_up(F.col(f"w{i}"), 1), 1),
                                                       F.lit(f"%) to environmentally-sensitive {s} sector")))
             for i, s in enumerate(L.SENSITIVE_SECTORS)]
    text = F.concat_ws("; ", *msgs)
    return g.select("portfolio_id", F.when(text != "", text).otherwise("No significant ESG risk exposures identified").alias("risks"))


def star_distribution(scored: DataFrame) -> DataFrame:
    """Holdings per star 1..5, zeros included."""
    g = scored.groupBy("portfolio_id").agg(*[F.count_if(F.col("stars") == i).alias(f"s{i}") for i in range(1, 6)])
    rows = F.array(*[F.struct(F.lit(i).alias("stars"), F.col(f"s{i}").alias("holdings")) for i in range(1, 6)])
    return g.select("portfolio_id", F.explode(rows).alias("r")).select("portfolio_id", "r.stars", "r.holdings")


def sfdr_compliance(esg: DataFrame) -> DataFrame:
    o = F.col("overall")
    return esg.select(
        "portfolio_id", "overall", (o >= 30).alias("article_6"), (o >= 60).alias("article_8"), (o >= 80).alias("article_9"),
        F.when(o >= 80, "Article 9 - Sustainable Investment").when(o >= 60, "Article 8 - ESG Promoting")
        .when(o >= 30, "Article 6 - ESG Integration").otherwise("Non-Compliant").alias("classification"),
        F.round(F.greatest(F.lit(0.0), 60 - o), 1).alias("points_to_article_8"),
        F.round(F.greatest(F.lit(0.0), 80 - o), 1).alias("points_to_article_9"),
        F.concat_ws("; ", F.when(o < 30, "Implement basic ESG integration framework"),
                    F.when(o < 60, "Enhance ESG promotion strategies"),
                    F.when(o < 80, "Develop sustainable investment criteria")).alias("advice"))


def sfdr_breakdown(scored: DataFrame) -> DataFrame:
    """Value and weight by holding-level article; whether articles 8 and 9 make half of the fund."""
    o = F.col("overall")
    art = F.when(o >= 70, "Article 9").when(o >= 50, "Article 8").otherwise("Article 6")
    g = scored.groupBy("portfolio_id", art.alias("article")).agg(F.sum("value").alias("v"))
    tv = F.sum("v").over(_by_portfolio())
    green = F.coalesce(F.sum(F.when(F.col("article") != "Article 6", F.col("v"))).over(_by_portfolio()), F.lit(0.0))
    return g.select("portfolio_id", "article", F.round("v", 2).alias("value"), F.round(F.col("v") / tv * 100, 4).alias("value_pct"),
                    F.round(green / tv * 100, 4).alias("esg_pct"), (F.round(green / tv, 9) >= 0.5).alias("qualifies"))


def esg_risk_summary(scored: DataFrame) -> DataFrame:
    risk = 100 - F.col("overall")
    g = scored.groupBy("portfolio_id").agg(
        F.sum("value").alias("tv"), F.sum(risk * F.col("value")).alias("rv"),
        F.coalesce(F.sum(F.when(risk > 50, F.col("value"))), F.lit(0.0)).alias("hv"), F.count_if(risk > 50).alias("high_risk_holdings"))
    return g.select("portfolio_id", F.round(F.col("rv") / F.col("tv"), 4).alias("esg_risk"),
                    F.round(F.col("hv") / F.col("tv") * 100, 4).alias("high_risk_pct"), "high_risk_holdings")


def high_risk_holdings(scored: DataFrame) -> DataFrame:
    return _weighted(scored).filter(100 - F.col("overall") > 50).select(
        "portfolio_id", "holding_id", "stock_name", F.round(100 - F.col("overall"), 2).alias("esg_risk"),
        F.round(F.col("weight") * 100, 4).alias("weight_pct"), F.round("value", 2).alias("value"))


def improvement_candidates(scored: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Holdings below the plain mean score of their portfolio, with the gap; ``of``: see ``portfolio.weights``."""
    mean = F.round(F.avg("overall"), 9)
    if "weight" in scored.columns:
        x = skew.attach(scored, scored.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_rows"), mean.alias("avg_esg")), ["portfolio_id"], ["holding_id"])
    else:
        x = weights(scored, {"avg_esg": mean}, of=of)  # both totals in one join
    return x.filter(F.col("overall") < F.col("avg_esg")).select(
        "portfolio_id", "holding_id", "stock_name", "sector", "overall", R.round_half_up(F.col("avg_esg"), 4).alias("avg_esg"),
        R.round_half_up(F.col("avg_esg") - F.col("overall"), 4).alias("gap"), F.round(F.col("weight") * 100, 4).alias("weight_pct"))


def improvement_potential(scored: DataFrame, points: float = 5.0) -> DataFrame:
    """Portfolio score now, and when every candidate (below the plain mean score) were replaced by one ``points`` better.

    Holdings are summed up by portfolio and score first: the scores have two digits, so a portfolio of any size has some
    thousand rows, which are compared with their mean.
    """
    g = scored.groupBy("portfolio_id", "overall").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    own = _by_portfolio()
    mean = F.sum(F.col("overall") * F.col("n")).over(own) / F.sum(F.when(F.col("overall").isNotNull(), F.col("n"))).over(own)
    x = g.withColumn("below", F.when(F.col("portfolio_id").isNotNull() & (F.col("overall") < F.round(mean, 9)), F.col("n")).otherwise(0))
    now = x.groupBy("portfolio_id").agg((F.sum(F.col("overall") * F.col("v")) / F.sum("v")).alias("score"), F.sum("below").alias("candidates"))
    return now.select("portfolio_id", F.round("score", 4).alias("score"), "candidates", F.round(F.col("score") + F.col("candidates") * points, 4).alias("potential"))


def esg_recommendations(esg: DataFrame, coverage: DataFrame, breakdown: DataFrame) -> DataFrame:
    low = (breakdown.filter("avg_esg_score < 50").groupBy("portfolio_id")
           .agg(F.concat_ws(", ", F.array_sort(F.collect_set("sector"))).alias("low_sectors")))  # sectors, not holdings
    j = esg.join(coverage.select("portfolio_id", "coverage_pct"), "portfolio_id").join(low, "portfolio_id", "left")
    cov, o = F.col("coverage_pct"), F.col("overall")
    covt = R.amount(cov, 1)
    text = F.concat_ws(
        "\n",
        F.when(cov < 50, F.concat(F.lit(L.ESG_ADVICE["coverage_low_start"]), covt, F.lit(L.ESG_ADVICE["coverage_low_end"])))
        .when(cov < 80, F.concat(F.lit(L.ESG_ADVICE["coverage_some_start"]), covt, F.lit(L.ESG_ADVICE["coverage_some_end"]))),
        F.when(o < 40, L.ESG_ADVICE["rating_low"])
        .when(o < 60, L.ESG_ADVICE["rating_average"])
        .when(o < 80, L.ESG_ADVICE["rating_strong"])
        .otherwise(L.ESG_ADVICE["rating_leader"]),
        F.when(F.col("low_sectors").isNotNull(), F.concat(F.lit(L.ESG_ADVICE["sectors_low_start"]), F.col("low_sectors"),
                                                          F.lit(L.ESG_ADVICE["sectors_low_end"]))))
    return j.select("portfolio_id", text.alias("recommendations"))


def esg_text_report(esg: DataFrame, coverage: DataFrame, recommendations: DataFrame) -> DataFrame:
    j = esg.join(coverage.select("portfolio_id", "coverage_pct"), "portfolio_id").join(recommendations, "portfolio_id")
    n1 = lambda c: R.amount(F.col(c), 1)
    text = F.concat_ws(
        "\n", F.lit("ESG Portfolio Analysis Report"),
        F.concat(F.lit("Overall ESG Rating: "), F.repeat(F.lit("*"), F.col("stars")), F.lit(" ("), F.col("stars").cast("string"), F.lit("/5) - "), F.col("label")),
        F.concat(F.lit("Environmental: "), n1("env"), F.lit("/100")), F.concat(F.lit("Social: "), n1("social"), F.lit("/100")),
        F.concat(F.lit("Governance: "), n1("gov"), F.lit("/100")), F.concat(F.lit("Overall Score: "), n1("overall"), F.lit("/100")),
        F.concat(F.lit("Risk Assessment: "), F.col("risk_level")),
        F.concat(F.lit("Data Coverage: "), n1("coverage_pct"), F.lit("% of portfolio")),
        F.lit("Key Recommendations:"), F.col("recommendations"))
    return j.select("portfolio_id", text.alias("report"))


def esg_adjusted_stress(explained: DataFrame, esg: DataFrame) -> DataFrame:
    j = explained.join(esg.select("portfolio_id", "risk_multiplier"), "portfolio_id")
    adj = F.col("impact_percentage") * F.col("risk_multiplier")
    return j.select("portfolio_id", "scenario_key", "impact_percentage", "risk_multiplier",
                    F.round(adj, 6).alias("adjusted_impact"), F.round(adj - F.col("impact_percentage"), 6).alias("difference"))


def combined_risk(explained: DataFrame, esg: DataFrame) -> DataFrame:
    m = explained.groupBy("portfolio_id").agg(F.avg(F.abs("impact_percentage")).alias("a"))
    j = m.join(esg.select("portfolio_id", "overall"), "portfolio_id")
    s, e = F.least(F.lit(100.0), F.col("a") * 3), 100 - F.col("overall")
    c = F.round(s * 0.6 + e * 0.4, 6)
    return j.select("portfolio_id", F.round(s, 6).alias("stress_risk"), F.round(e, 6).alias("esg_risk"), c.alias("combined_risk"),
                    F.when(c < 30, "LOW").when(c < 50, "MODERATE").when(c < 70, "HIGH").otherwise("SEVERE").alias("risk_level"))


def top_bottom_performers(scored: DataFrame, top: int = 5, bottom: int = 3, portfolio_keys: DataFrame | None = None,
                          hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Best and worst holdings by score (ties by holding id); missing scores come last in top, first in bottom.

    Every map task sends on k rows per portfolio and side.  With ``portfolio_keys``, a table with about as many rows per
    portfolio_id as ``scored`` that is cheap to count, this is kept for portfolios with more than ``hot_rows`` rows there; of all
    others one shuffle and one sort rank both sides, as bottom is the order of top from its end.
    """
    cols = ["portfolio_id", "holding_id", "stock_name", "overall"]
    x = scored.select(*cols)
    if portfolio_keys is None:
        return _ranked_by_side(x, top, bottom)
    hot = skew.hot_keys(portfolio_keys, "portfolio_id", hot_rows)
    if hot.isEmpty():
        return _ranked_together(x, top, bottom)
    keys = F.broadcast(hot.withColumnRenamed("portfolio_id", "_hot"))
    same = F.col("portfolio_id").eqNullSafe(F.col("_hot"))
    return _ranked_together(x.join(keys, same, "left_anti"), top, bottom).unionByName(_ranked_by_side(x.join(keys, same, "left_semi"), top, bottom))


def _ranked_together(x: DataFrame, top: int, bottom: int) -> DataFrame:
    own = Window.partitionBy("portfolio_id")
    t = F.row_number().over(own.orderBy(F.col("overall").isNull(), F.desc("overall"), F.asc("holding_id")))
    ranked = x.withColumn("_t", t).withColumn("_b", (F.count(F.lit(1)).over(own) - F.col("_t") + 1).cast("int"))
    side = lambda name, rank, k: F.when(F.col(rank) <= k, F.struct(F.col(rank).alias("position"), F.lit(name).alias("side")))
    sides = F.filter(F.array(side("top", "_t", top), side("bottom", "_b", bottom)), lambda s: s.isNotNull())
    return ranked.filter((F.col("_t") <= top) | (F.col("_b") <= bottom)).select(*x.columns, F.explode(sides).alias("s")).select(*x.columns, "s.position", "s.side")


def _ranked_by_side(x: DataFrame, top: int, bottom: int) -> DataFrame:
    both = x.select(*x.columns, F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("side"))
    is_top = F.col("side") == "top"
    w = Window.partitionBy("portfolio_id", "side").orderBy(
        F.when(is_top, F.col("overall").isNull()).otherwise(F.col("overall").isNotNull()),
        F.when(is_top, -F.col("overall")).otherwise(F.col("overall")),
        F.when(is_top, F.col("holding_id")).asc(), F.when(~is_top, F.col("holding_id")).desc())
    ranked = both.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= max(top, bottom))
    return ranked.filter(F.col("position") <= F.when(is_top, top).otherwise(bottom)).select(*x.columns, "position", "side")


def esg_table(scored: DataFrame) -> DataFrame:
    """Display columns per holding; sort by ``overall`` to show them."""
    whole = lambda c: R.amount(R.round_half_up(F.col(c), 0), 0)
    x = with_weight_pct(scored)
    return x.select("portfolio_id", "holding_id", F.col("stock_name").alias("stock"), "sector", whole("env").alias("e"),
                    whole("social").alias("s"), whole("gov").alias("g"), R.amount(F.col("overall"), 2).alias("overall"),
                    F.repeat(F.lit("*"), F.col("stars")).alias("rating"), "label",
                    F.concat(R.amount(R.round_half_up(F.col("weight_pct"), 1), 1), F.lit("%")).alias("weight"),
                    F.when(F.col("is_proxy"), "Proxy").otherwise("Real").alias("source"))


def esg_monitor(scored: DataFrame) -> DataFrame:
    """Model scores close to 50 and with many imputed inputs, per portfolio with model scores."""
    m = scored.filter("tier = 'model'")
    near = F.abs(F.col("overall") - 50) < 0.1
    g = m.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("ml_holdings"), F.count_if(near).alias("near_50"),
                                      F.count_if(F.col("imputation_ratio") > 0.2).alias("high_imputation"))
    share = F.col("near_50") / F.col("ml_holdings")
    return g.select("portfolio_id", "ml_holdings", "near_50", F.round(share, 6).alias("near_50_share"),
                    (share > 0.3).alias("near_50_warning"), "high_imputation")


# joins with other tables -----------------------------------------------------------------------------
def join_scores(h: DataFrame, scores: DataFrame, key: str = "security_id") -> DataFrame:
    """Holdings that have a score (one score row per key)."""
    marked = scores.withColumn("_scored", F.lit(True))
    return skew.join_dimension(h, marked, key, ["holding_id"]).filter("_scored").drop("_scored")


def sector_benchmark(scored: DataFrame, benchmark: DataFrame) -> DataFrame:
    g = scored.groupBy("portfolio_id", "sector").agg(F.avg("overall").alias("a"), F.sum("value").alias("v"))
    g = g.withColumn("w", F.col("v") / F.sum("v").over(_by_portfolio()))
    j = g.join(skew.small_side(benchmark), "sector", "left")
    score = R.round_half_up(F.col("a"), 2)
    vs = F.round(score - F.col("benchmark"), 2)
    return j.select("portfolio_id", "sector", score.alias("esg_score"), R.round_half_up(F.col("w"), 2).alias("weight"),
                    F.round("v", 2).alias("value"), "benchmark", vs.alias("vs_benchmark"),
                    F.when(vs > 0, "outperformer").when(vs < 0, "underperformer").when(vs == 0, "in line").otherwise("no benchmark").alias("status"))


def sector_screen(h: DataFrame, screens: dict[str, list[str]]) -> DataFrame:
    """Each holding with the screen its sector is on (none otherwise) and its weight."""
    rows = [(s, name) for name, sectors in screens.items() for s in sectors]
    lists = F.broadcast(h.sparkSession.createDataFrame(rows, "sector string, screen string"))
    return weights(h).join(lists, "sector", "left").select(
        "portfolio_id", "holding_id", "sector", F.coalesce("screen", F.lit("none")).alias("screen"),
        F.round(F.col("weight") * 100, 4).alias("weight_pct"))


