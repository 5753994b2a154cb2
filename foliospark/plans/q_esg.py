"""Queries: ESG scores of holdings and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import skew
from ..functions.storage import cut_lineage
from ..operators import esg as E
from ..operators import market as M
from ..operators import portfolio as P
from . import views as V
from .q_market import snapshots
from .q_stress import explained
from .registry import query
from .sql_views import VIEWS

_DAYS = 5


def half(x, n):
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {n}) AS DOUBLE)"


def _cases(expr, cuts, default, op=">="):
    return "CASE " + " ".join(f"WHEN {expr} {op} {c} THEN {v}" for c, v in cuts) + f" ELSE {default} END"


def _stars(x):
    return _cases(x, [(80, 5), (60, 4), (40, 3), (20, 2)], 1)


def tiers(spark, d):
    snap = M.fresh_snapshot(snapshots(spark, d), V.AS_OF, _DAYS)
    return E.resolve_esg_tier(V.securities(spark, d), snap, V.company_esg(spark, d), V.predictions(spark, d))


def scored(spark, d, h=None):
    # a holding is a line, so counting lines per part spares the joins of the holdings
    keys = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("security_id")) if h is None else None
    return E.score_holdings(V.holdings(spark, d) if h is None else h, tiers(spark, d), security_rows=V.table(spark, d, "part").count(), security_keys=keys)


def bare_holdings(spark, d):
    """What scores and weights need of the holdings, joined and written once."""
    return cut_lineage(V.holdings(spark, d).select("portfolio_id", "holding_id", "security_id", "stock_name", "sector", "value"))


def scored_w(spark, d):
    """Scores first, then weights: the rows of a portfolio are together at the end, so sums by portfolio shuffle little."""
    h = bare_holdings(spark, d)
    return P.weights(scored(spark, d, h), of=h)


VIEWS["sql_tiers"] = f"""
  SELECT x.security_id, market_cap, CASE WHEN n.ticker IS NOT NULL THEN 'api' WHEN c.ticker IS NOT NULL THEN 'company'
           WHEN p.security_id IS NOT NULL THEN 'model' ELSE 'proxy' END AS tier,
         CASE WHEN n.ticker IS NOT NULL THEN n.e WHEN c.ticker IS NOT NULL THEN c.e ELSE m_e END AS e,
         CASE WHEN n.ticker IS NOT NULL THEN n.s WHEN c.ticker IS NOT NULL THEN c.s ELSE m_s END AS s,
         CASE WHEN n.ticker IS NOT NULL THEN n.g WHEN c.ticker IS NOT NULL THEN c.g ELSE m_g END AS g,
         CASE WHEN n.ticker IS NULL AND c.ticker IS NULL THEN predicted END AS predicted,
         CASE WHEN n.ticker IS NULL AND c.ticker IS NULL THEN imputation_ratio END AS imputation_ratio
  FROM securities x LEFT JOIN (SELECT * FROM sql_latest WHERE date_diff('day', CAST(fetch_ts AS DATE), DATE '{V.AS_OF}') <= {_DAYS}) n ON n.ticker = x.ticker
  LEFT JOIN company_esg c ON c.ticker = x.ticker LEFT JOIN (SELECT * FROM predictions WHERE imputation_ratio <= 0.45) p ON p.security_id = x.security_id"""
VIEWS["sql_scored"] = f"""
  WITH b AS (SELECT h.*, t.tier, t.e, t.s, t.g, t.predicted, t.imputation_ratio, t.market_cap IS NOT NULL AS cap_known,
               CASE WHEN coalesce(market_cap, value) >= 5e10 THEN 1.1::DOUBLE WHEN coalesce(market_cap, value) >= 5e9 THEN 1.0 ELSE 0.9 END AS f
             FROM holdings h JOIN sql_tiers t USING (security_id)),
  j AS (SELECT b.*, coalesce(we, 0.4::DOUBLE) AS we, coalesce(ws, 0.3::DOUBLE) AS ws, coalesce(wg, 0.3::DOUBLE) AS wg, d.e * f AS de, d.s * f AS ds, d.g * f AS dg
        FROM b LEFT JOIN lk_sector_esg_weight w ON w.sector = b.sector
        JOIN lk_sector_esg_default d ON d.sector = CASE WHEN b.sector IN (SELECT sector FROM lk_sector_esg_default) THEN b.sector ELSE 'Other' END),
  k AS (SELECT *, {half("CASE WHEN tier = 'proxy' THEN de ELSE coalesce(e, predicted) END", 2)} AS env,
               {half("CASE WHEN tier = 'proxy' THEN ds ELSE coalesce(s, predicted) END", 2)} AS social,
               {half("CASE WHEN tier = 'proxy' THEN dg ELSE coalesce(g, predicted) END", 2)} AS gov,
               {half("CASE WHEN tier = 'proxy' THEN (de + ds + dg) / 3 ELSE coalesce(e * we + s * ws + g * wg, predicted) END", 2)} AS overall FROM j)
  SELECT *, {_stars('overall')} AS stars, tier = 'proxy' AS is_proxy, sum(value) OVER (PARTITION BY portfolio_id) AS tv,
         value / sum(value) OVER (PARTITION BY portfolio_id) AS weight,
         {half("value / sum(value) OVER (PARTITION BY portfolio_id) * 100", 2)} AS weight_pct FROM k"""
_LABEL = "(['Laggard', 'Below Average', 'Average', 'Strong', 'Leader'])[stars]"
VIEWS["sql_pesg"] = f"""
  WITH g AS (SELECT portfolio_id, count(*) AS total_holdings, sum(value) AS tv, sum(value * env) / sum(value) AS e, sum(value * social) / sum(value) AS s,
                    sum(value * gov) / sum(value) AS g, sum(value * overall) / sum(value) AS o FROM sql_scored GROUP BY 1),
  x AS (SELECT *, {_stars('o')} AS stars FROM g)
  SELECT portfolio_id, round(e, 1) AS env, round(s, 1) AS social, round(g, 1) AS gov, round(o, 1) AS overall, stars, {_LABEL} AS label,
         {_cases('round(o, 1)', [(80, "'Low Risk'"), (60, "'Medium Risk'"), (40, "'High Risk'")], "'Extreme Risk'")} AS risk_level,
         CAST({_cases('o', [(80, 0.8), (60, 0.9), (40, 1.0), (20, 1.15)], 1.3)} AS DOUBLE) AS risk_multiplier, total_holdings, round(tv, 2) AS total_value FROM x"""


@query("d5_resolve_esg_tier", """
  SELECT security_id, tier, round(e, 4) AS e, round(s, 4) AS s, round(g, 4) AS g, round(predicted, 4) AS predicted, imputation_ratio FROM sql_tiers""")
def _(spark, d):
    return tiers(spark, d).select("security_id", "tier", *[F.round(c, 4).alias(c) for c in ("e", "s", "g", "predicted")], "imputation_ratio")


def _proxy_table(spark, d):
    """A proxy database for three sectors, derived from the whole supplier table; Other has no Mid row."""
    s = V.table(spark, d, "supplier").selectExpr(
        V.pick_sql(["Banking", "FMCG", "Other"], "s_nationkey % 3") + " AS sector",
        "CASE WHEN s_acctbal > 6000 THEN 'Large' WHEN s_acctbal > 2500 THEN 'Mid' ELSE 'Small' END AS market_cap_range", "s_suppkey")
    g = s.groupBy("sector", "market_cap_range").agg(F.max("s_suppkey").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.filter("NOT (sector = 'Other' AND market_cap_range = 'Mid')").selectExpr(
        "sector", "market_cap_range", "40 + k % 80 * 1.25D AS environmental_score", "n % 90 * 1.5D AS social_score",
        "30 + k % 60 * 0.5D AS governance_score", "45 + k % 50 * 0.125D AS overall_esg", "'Proxy DB' AS data_source")


VIEWS["sql_proxy_table"] = """
  SELECT sector, band, 40 + k % 80 * 1.25::DOUBLE AS e, n % 90 * 1.5::DOUBLE AS s, 30 + k % 60 * 0.5::DOUBLE AS g, 45 + k % 50 * 0.125::DOUBLE AS o
  FROM (SELECT (['Banking', 'FMCG', 'Other'])[1 + s_nationkey % 3] AS sector,
          CASE WHEN s_acctbal > 6000 THEN 'Large' WHEN s_acctbal > 2500 THEN 'Mid' ELSE 'Small' END AS band, max(s_suppkey) AS k, count(*) AS n FROM supplier GROUP BY 1, 2)
  WHERE NOT (sector = 'Other' AND band = 'Mid')"""


@query("d4_proxy_lookup", f"""
  WITH f AS (SELECT symbol, sector, marketCap, {_cases('marketCap', [('5e10', "'Large'"), ('5e9', "'Mid'")], "'Small'")} AS band,
               CAST({_cases('marketCap', [('5e10', 1.1), ('5e9', 1.0)], 0.9)} AS DOUBLE) AS fac FROM features),
  j AS (SELECT f.*, coalesce(a.e, b.e, d.e * fac) AS e, coalesce(a.s, b.s, d.s * fac) AS s, coalesce(a.g, b.g, d.g * fac) AS g,
               coalesce(a.o, b.o, (d.e * fac + d.s * fac + d.g * fac) / 3) AS o,
               CASE WHEN coalesce(a.o, b.o) IS NOT NULL THEN 'Proxy DB' ELSE 'Sector Average (' || f.sector || ')' END || ' (Proxy)' AS px_source
        FROM f LEFT JOIN sql_proxy_table a ON a.sector = f.sector AND a.band = f.band LEFT JOIN sql_proxy_table b ON b.sector = 'Other' AND b.band = f.band
        JOIN lk_sector_esg_default d ON d.sector = CASE WHEN f.sector IN (SELECT sector FROM lk_sector_esg_default) THEN f.sector ELSE 'Other' END)
  SELECT symbol, band AS px_band, {half('greatest(0, least(100, e))', 2)} AS px_e, {half('greatest(0, least(100, s))', 2)} AS px_s,
         {half('greatest(0, least(100, g))', 2)} AS px_g, {half('greatest(0, least(100, o))', 2)} AS px_overall, px_source FROM j""")
def _(spark, d):
    f = V.features(spark, d).select("symbol", "sector", "marketCap")
    x = E.proxy_lookup(f, F.col("marketCap"), _proxy_table(spark, d))
    return x.select("symbol", "px_band", "px_e", "px_s", "px_g", "px_overall", "px_source")


@query("e18_holding_esg", f"""
  SELECT portfolio_id, holding_id, tier, env, social, gov, overall, stars, {_LABEL} AS label, is_proxy, cap_known FROM sql_scored""")
def _(spark, d):
    return scored(spark, d).select("portfolio_id", "holding_id", "tier", "env", "social", "gov", "overall", "stars", "label", "is_proxy", "cap_known")


@query("e17_portfolio_esg", "SELECT * FROM sql_pesg")
def _(spark, d):
    return E.portfolio_esg(scored(spark, d))


VIEWS["sql_coverage"] = """
  SELECT portfolio_id, round(greatest(0, least(100, coalesce(sum(value) FILTER (NOT is_proxy), 0) / sum(value) * 100)), 1) AS coverage_pct,
         count(*) FILTER (NOT is_proxy) AS rated_holdings, count(*) FILTER (is_proxy) AS unrated_holdings, count(*) FILTER (tier IN ('api', 'company')) AS api_data,
         count(*) FILTER (tier = 'model') AS ml_predictions, count(*) FILTER (is_proxy) AS sector_proxy,
         round(count(*) FILTER (tier IN ('api', 'company')) / count(*) * 100, 4) AS api_share, round(count(*) FILTER (tier = 'model') / count(*) * 100, 4) AS ml_share,
         round(count(*) FILTER (is_proxy) / count(*) * 100, 4) AS proxy_share FROM sql_scored GROUP BY 1"""


@query("e19_esg_coverage", "SELECT * FROM sql_coverage")
def _(spark, d):
    return E.esg_coverage(scored(spark, d))


VIEWS["sql_breakdown"] = f"""
  SELECT portfolio_id, sector, count(*) AS count, {half('sum(weight_pct)', 1)} AS total_weight, {half('avg(overall)', 1)} AS avg_esg_score,
         {half('avg(env)', 1)} AS avg_env, {half('avg(social)', 1)} AS avg_social, {half('avg(gov)', 1)} AS avg_gov FROM sql_scored GROUP BY 1, 2"""


@query("e20_esg_sector_breakdown", "SELECT * FROM sql_breakdown")
def _(spark, d):
    return E.esg_sector_breakdown(scored_w(spark, d))


@query("e20_esg_sector_members", """
  SELECT portfolio_id, sector, stock_name, count(*) AS holdings, round(sum(value), 2) AS value FROM holdings GROUP BY 1, 2, 3""")
def _(spark, d):
    return P.sector_members(V.holdings(spark, d))


@query("f11_rank_within_sector", """
  SELECT portfolio_id, sector, avg_esg_score, total_weight,
         CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY avg_esg_score DESC, sector) AS INT) AS rank FROM sql_breakdown""")
def _(spark, d):
    return E.rank_sectors(E.esg_sector_breakdown(scored_w(spark, d)))


_SENS = ["Energy", "Oil & Gas", "Metals & Mining", "Chemicals"]
_SENS_SUM = ", ".join(f"coalesce(sum(weight_pct) FILTER (sector = '{s}'), 0) AS w{i}" for i, s in enumerate(_SENS))
_SENS_MSG = ", ".join(f"CASE WHEN round(w{i}, 6) > 30 THEN 'Sector Risk: High exposure (' || CAST(round(CAST(w{i} AS DECIMAL(38,9)), 1) AS DECIMAL(38,1)) || '%) to environmentally-sensitive {s} sector' END"
                      for i, s in enumerate(_SENS))


def _pct0(c):
    return f"CAST(CAST(round(CAST({c} / n * 100 AS DECIMAL(38,9)), 0) AS DECIMAL(38,0)) AS VARCHAR)"


@query("e21_esg_exposures", f"""
  WITH g AS (SELECT portfolio_id, count(*) AS n, count(*) FILTER (stars <= 2) AS low, count(*) FILTER (is_proxy) AS px, {_SENS_SUM} FROM sql_scored GROUP BY 1),
  t AS (SELECT portfolio_id, concat_ws('; ', CASE WHEN low / n > 0.3 THEN 'High Risk: ' || low || ' holdings (' || {_pct0('low')} || '%) rated 1 or 2 stars' END,
     CASE WHEN px / n > 0.5 THEN 'Data Risk: ' || px || ' holdings (' || {_pct0('px')} || '%) using estimated ESG scores' END, {_SENS_MSG}) AS t FROM g)
  SELECT portfolio_id, CASE WHEN t <> '' THEN t ELSE 'No significant ESG risk exposures identified' END AS risks FROM t""")
def _(spark, d):
    return E.esg_exposures(scored_w(spark, d))


@query("e22_star_distribution", """
  SELECT p.portfolio_id, CAST(k AS INT) AS stars, count(s.holding_id) AS holdings
  FROM (SELECT DISTINCT portfolio_id FROM sql_scored) p JOIN unnest(range(1, 6)) AS u(k) ON true
  LEFT JOIN sql_scored s ON s.portfolio_id = p.portfolio_id AND s.stars = k GROUP BY 1, 2""")
def _(spark, d):
    return E.star_distribution(scored(spark, d))


@query("e23_sfdr_compliance", """
  SELECT portfolio_id, overall, overall >= 30 AS article_6, overall >= 60 AS article_8, overall >= 80 AS article_9,
    CASE WHEN overall >= 80 THEN 'Article 9 - Sustainable Investment' WHEN overall >= 60 THEN 'Article 8 - ESG Promoting'
         WHEN overall >= 30 THEN 'Article 6 - ESG Integration' ELSE 'Non-Compliant' END AS classification,
    round(greatest(0, 60 - overall), 1) AS points_to_article_8, round(greatest(0, 80 - overall), 1) AS points_to_article_9,
    concat_ws('; ', CASE WHEN overall < 30 THEN 'Implement basic ESG integration framework' END, CASE WHEN overall < 60 THEN 'Enhance ESG promotion strategies' END,
              CASE WHEN overall < 80 THEN 'Develop sustainable investment criteria' END) AS advice FROM sql_pesg""")
def _(spark, d):
    return E.sfdr_compliance(E.portfolio_esg(scored(spark, d)))


@query("e24_sfdr_breakdown", """
  WITH g AS (SELECT portfolio_id, CASE WHEN overall >= 70 THEN 'Article 9' WHEN overall >= 50 THEN 'Article 8' ELSE 'Article 6' END AS article, sum(value) AS v FROM sql_scored GROUP BY 1, 2),
  t AS (SELECT *, sum(v) OVER p AS tv, coalesce(sum(v) FILTER (article <> 'Article 6') OVER p, 0) AS gv FROM g WINDOW p AS (PARTITION BY portfolio_id))
  SELECT portfolio_id, article, round(v, 2) AS value, round(v / tv * 100, 4) AS value_pct, round(gv / tv * 100, 4) AS esg_pct, round(gv / tv, 9) >= 0.5 AS qualifies FROM t""")
def _(spark, d):
    return E.sfdr_breakdown(scored(spark, d))


@query("e25_esg_risk_summary", """
  SELECT portfolio_id, round(sum((100 - overall) * value) / sum(value), 4) AS esg_risk,
         round(coalesce(sum(value) FILTER (100 - overall > 50), 0) / sum(value) * 100, 4) AS high_risk_pct, count(*) FILTER (100 - overall > 50) AS high_risk_holdings
  FROM sql_scored GROUP BY 1""")
def _(spark, d):
    return E.esg_risk_summary(scored(spark, d))


@query("e25_high_risk_holdings", """
  SELECT portfolio_id, holding_id, stock_name, round(100 - overall, 2) AS esg_risk, round(weight * 100, 4) AS weight_pct, round(value, 2) AS value
  FROM sql_scored WHERE 100 - overall > 50""")
def _(spark, d):
    return E.high_risk_holdings(scored_w(spark, d))


_CANDIDATE = ["portfolio_id", "holding_id", "stock_name", "sector", "overall", "value"]
VIEWS["sql_cand"] = """
  SELECT * FROM (SELECT *, round(avg(overall) OVER (PARTITION BY portfolio_id), 9) AS avg_esg FROM sql_scored) WHERE overall < avg_esg"""


@query("e26_improvement_candidates", f"""
  SELECT portfolio_id, holding_id, stock_name, sector, overall, {half("avg_esg", 4)} AS avg_esg, {half("avg_esg - overall", 4)} AS gap, round(weight * 100, 4) AS weight_pct FROM sql_cand""")
def _(spark, d):
    h = bare_holdings(spark, d)
    return E.improvement_candidates(cut_lineage(scored(spark, d, h).select(*_CANDIDATE)), of=h)


@query("e26_improvement_potential", """
  WITH n AS (SELECT portfolio_id, count(*) AS c FROM sql_cand GROUP BY 1),
  s AS (SELECT portfolio_id, sum(overall * value) / sum(value) AS score FROM sql_scored GROUP BY 1)
  SELECT portfolio_id, round(score, 4) AS score, coalesce(c, 0) AS candidates, round(score + coalesce(c, 0) * 5.0::DOUBLE, 4) AS potential FROM s LEFT JOIN n USING (portfolio_id)""")
def _(spark, d):
    return E.improvement_potential(scored(spark, d))


_RECO = r"""
  WITH l AS (SELECT portfolio_id, string_agg(sector, ', ' ORDER BY sector) AS low FROM sql_breakdown WHERE avg_esg_score < 50 GROUP BY 1),
  j AS (SELECT p.*, c.coverage_pct, l.low FROM sql_pesg p JOIN sql_coverage c USING (portfolio_id) LEFT JOIN l USING (portfolio_id))
  SELECT portfolio_id, concat_ws(chr(10),
    CASE WHEN coverage_pct < 50 THEN 'ESG data coverage is only ' || CAST(coverage_pct AS DECIMAL(38,1)) || '%. Consider focusing on larger, better-documented holdings.'
         WHEN coverage_pct < 80 THEN 'ESG data available for ' || CAST(coverage_pct AS DECIMAL(38,1)) || '% of portfolio. Some scores are estimated using sector proxies.' END,
    CASE WHEN overall < 40 THEN concat_ws(chr(10), 'Portfolio has LOW ESG rating. Major improvements needed:', '- Divest from bottom-rated ESG holdings', '- Increase allocation to 4 and 5 star ESG companies')
         WHEN overall < 60 THEN concat_ws(chr(10), 'Portfolio has AVERAGE ESG rating. Improvement opportunities:', '- Gradually shift allocation toward higher-rated ESG holdings', '- Engage with low-performers on ESG improvements')
         WHEN overall < 80 THEN concat_ws(chr(10), 'Portfolio has STRONG ESG rating. Maintain and enhance:', '- Monitor for any ESG deterioration in holdings', '- Consider upgrading remaining 3 star holdings to 4 stars or more')
         ELSE concat_ws(chr(10), 'Portfolio has LEADER ESG rating. Maintain excellence:', '- Continue ESG leadership and monitoring', '- Share ESG best practices with investees') END,
    CASE WHEN low IS NOT NULL THEN 'Low ESG performance in sectors: ' || low || chr(10) || '- Consider sector rotation toward ESG-friendly sectors' END) AS recommendations FROM j"""


def _rated(spark, d):
    """Scores and weights that several results are drawn from, written once."""
    return cut_lineage(scored_w(spark, d).select("portfolio_id", "sector", "value", "tier", "is_proxy", "env", "social", "gov", "overall", "weight"))


def _reco(s):
    return E.esg_recommendations(E.portfolio_esg(s), E.esg_coverage(s), E.esg_sector_breakdown(s))


@query("e27_esg_recommendations", _RECO)
def _(spark, d):
    return _reco(_rated(spark, d))


VIEWS["sql_reco"] = _RECO


def _d1(c):
    return f"CAST(CAST({c} AS DECIMAL(38,1)) AS VARCHAR)"


@query("e28_esg_text_report", f"""
  SELECT portfolio_id, concat_ws(chr(10), 'ESG Portfolio Analysis Report', 'Overall ESG Rating: ' || repeat('*', stars) || ' (' || stars || '/5) - ' || label,
     'Environmental: ' || {_d1('env')} || '/100', 'Social: ' || {_d1('social')} || '/100', 'Governance: ' || {_d1('gov')} || '/100',
     'Overall Score: ' || {_d1('overall')} || '/100', 'Risk Assessment: ' || risk_level, 'Data Coverage: ' || {_d1('coverage_pct')} || '% of portfolio',
     'Key Recommendations:', recommendations) AS report
  FROM sql_pesg JOIN sql_coverage USING (portfolio_id) JOIN sql_reco USING (portfolio_id)""")
def _(spark, d):
    s = _rated(spark, d)
    return E.esg_text_report(E.portfolio_esg(s), E.esg_coverage(s), _reco(s))


@query("e29_esg_adjusted_stress", """
  SELECT e.portfolio_id, scenario_key, impact_percentage, risk_multiplier, round(impact_percentage * risk_multiplier, 6) AS adjusted_impact,
         round(impact_percentage * risk_multiplier - impact_percentage, 6) AS difference FROM sql_explained e JOIN sql_pesg p USING (portfolio_id)""")
def _(spark, d):
    return E.esg_adjusted_stress(explained(spark, d), E.portfolio_esg(scored(spark, d)))


@query("e30_combined_risk", """
  WITH m AS (SELECT portfolio_id, least(100, avg(abs(impact_percentage)) * 3) AS s FROM sql_explained GROUP BY 1),
  c AS (SELECT portfolio_id, s, 100 - overall AS e, round(s * 0.6::DOUBLE + (100 - overall) * 0.4::DOUBLE, 6) AS c FROM m JOIN sql_pesg USING (portfolio_id))
  SELECT portfolio_id, round(s, 6) AS stress_risk, round(e, 6) AS esg_risk, c AS combined_risk,
         CASE WHEN c < 30 THEN 'LOW' WHEN c < 50 THEN 'MODERATE' WHEN c < 70 THEN 'HIGH' ELSE 'SEVERE' END AS risk_level FROM c""")
def _(spark, d):
    return E.combined_risk(explained(spark, d), E.portfolio_esg(scored(spark, d)))


@query("f7_top_bottom_performers", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY overall DESC, holding_id) AS t,
                    row_number() OVER (PARTITION BY portfolio_id ORDER BY overall, holding_id DESC) AS b FROM sql_scored)
  SELECT portfolio_id, holding_id, stock_name, overall, CAST(t AS INT) AS position, 'top' AS side FROM r WHERE t <= 5
  UNION ALL SELECT portfolio_id, holding_id, stock_name, overall, CAST(b AS INT), 'bottom' FROM r WHERE b <= 3""")
def _(spark, d):
    keys = V.table(spark, d, "orders").select(F.col("o_custkey").alias("portfolio_id"))  # an order has a few lines
    return E.top_bottom_performers(scored(spark, d), portfolio_keys=keys, hot_rows=skew.HOT_ROWS // 4)


def _whole(c):
    return f"CAST(CAST(round(CAST({c} AS DECIMAL(38,9)), 0) AS DECIMAL(38,0)) AS VARCHAR)"


@query("g3_esg_table", f"""
  SELECT portfolio_id, holding_id, stock_name AS stock, sector, {_whole('env')} AS e, {_whole('social')} AS s, {_whole('gov')} AS g,
         CAST(CAST(overall AS DECIMAL(38,2)) AS VARCHAR) AS overall, repeat('*', stars) AS rating, {_LABEL} AS label,
         CAST(CAST(round(CAST(weight_pct AS DECIMAL(38,9)), 1) AS DECIMAL(38,1)) AS VARCHAR) || '%' AS weight,
         CASE WHEN is_proxy THEN 'Proxy' ELSE 'Real' END AS source FROM sql_scored""")
def _(spark, d):
    return E.esg_table(scored_w(spark, d))


@query("e44_esg_monitor", """
  WITH g AS (SELECT portfolio_id, count(*) AS ml_holdings, count(*) FILTER (abs(overall - 50) < 0.1) AS near_50,
                    count(*) FILTER (imputation_ratio > 0.2) AS high_imputation FROM sql_scored WHERE tier = 'model' GROUP BY 1)
  SELECT portfolio_id, ml_holdings, near_50, round(near_50 / ml_holdings, 6) AS near_50_share, near_50 / ml_holdings > 0.3 AS near_50_warning, high_imputation FROM g""")
def _(spark, d):
    return E.esg_monitor(scored(spark, d))


@query("e47_portfolio_profile_defaults", """
  SELECT c_custkey AS portfolio_id, coalesce(env, 0) AS env, coalesce(social, 0) AS social, coalesce(gov, 0) AS gov, coalesce(overall, 0) AS overall,
         coalesce(stars, 0) AS stars, coalesce(label, 'No Data') AS label, coalesce(risk_level, 'Unable to assess') AS risk_level,
         coalesce(risk_multiplier, 1) AS risk_multiplier, coalesce(total_holdings, 0) AS total_holdings, coalesce(total_value, 0) AS total_value
  FROM customer LEFT JOIN (SELECT * FROM sql_pesg WHERE portfolio_id % 5 <> 0) p ON portfolio_id = c_custkey""")
def _(spark, d):
    # every fifth portfolio has no valued holding
    esg = E.portfolio_esg(scored(spark, d).withColumn("value", F.when(F.col("portfolio_id") % 5 != 0, F.col("value")).otherwise(0.0)))
    return E.portfolio_profile(V.table(spark, d, "customer").select(F.col("c_custkey").alias("portfolio_id")), esg)


@query("d1_join_scores", """
  SELECT portfolio_id, round(sum(value * total_esg) / sum(value), 4) AS portfolio_score, count(*) AS scored_holdings
  FROM holdings JOIN features ON symbol = security_id WHERE total_esg IS NOT NULL GROUP BY 1""")
def _(spark, d):
    scores = V.features(spark, d).filter("total_esg IS NOT NULL").select(F.col("symbol").alias("security_id"), "total_esg")
    j = E.join_scores(V.holdings(spark, d), scores)
    return j.groupBy("portfolio_id").agg(
        F.round(F.sum(F.col("value") * F.col("total_esg")) / F.sum("value"), 4).alias("portfolio_score"),
        F.count(F.lit(1)).alias("scored_holdings"))


_BENCH = {"IT Services": "IT", "Banking": "Financials", "Oil & Gas": "Energy", "Pharmaceuticals": "Healthcare", "Metals & Mining": "Industrials"}


@query("d7_sector_benchmark", f"""
  WITH s AS (SELECT portfolio_id, CASE sector {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _BENCH.items())} ELSE sector END AS sector, overall, value FROM sql_scored),
  g AS (SELECT portfolio_id, sector, {half('avg(overall)', 2)} AS esg_score, sum(value) AS v FROM s GROUP BY 1, 2),
  w AS (SELECT *, {half('v / sum(v) OVER (PARTITION BY portfolio_id)', 2)} AS weight FROM g),
  b AS (SELECT w.*, benchmark, round(esg_score - benchmark, 2) AS vs_benchmark FROM w LEFT JOIN lk_sector_benchmark USING (sector))
  SELECT portfolio_id, sector, esg_score, weight, round(v, 2) AS value, benchmark, vs_benchmark,
         CASE WHEN vs_benchmark > 0 THEN 'outperformer' WHEN vs_benchmark < 0 THEN 'underperformer' WHEN vs_benchmark = 0 THEN 'in line' ELSE 'no benchmark' END AS status FROM b""")
def _(spark, d):
    from ..functions.lookups import lookup
    s = scored(spark, d)
    sector = F.col("sector")
    name = F
    for a, b in _BENCH.items():
        name = name.when(sector == a, F.lit(b))
    return E.sector_benchmark(s.withColumn("sector", name.otherwise(sector)), lookup(spark, "sector_benchmark"))


@query("d8_sector_screen", """
  SELECT portfolio_id, holding_id, sector, CASE WHEN sector IN ('Oil & Gas', 'Metals & Mining') THEN 'risk' WHEN sector IN ('IT Services', 'Pharmaceuticals') THEN 'opportunity'
         ELSE 'none' END AS screen, round(value / sum(value) OVER (PARTITION BY portfolio_id) * 100, 4) AS weight_pct FROM holdings""")
def _(spark, d):
    return E.sector_screen(V.holdings(spark, d), {"risk": ["Oil & Gas", "Metals & Mining"], "opportunity": ["IT Services", "Pharmaceuticals"]})


@query("e14_sector_mix_detail", """
  WITH m AS (SELECT symbol AS security_id, sector AS ms, CASE WHEN marketCap >= 1e10 THEN 'Large Cap' WHEN marketCap >= 2e9 THEN 'Mid Cap' ELSE 'Small Cap' END AS cap
             FROM features WHERE marketCap IS NOT NULL),
  w AS (SELECT n.stock_name, coalesce(arg_min(k.sector, k.ord), 'Diversified') AS ws FROM (SELECT DISTINCT stock_name FROM holdings) n
        LEFT JOIN lk_simple_keyword k ON contains(upper(n.stock_name), k.keyword) GROUP BY 1),
  g AS (SELECT portfolio_id, coalesce(ms, ws) AS sector, coalesce(cap, 'Unknown Cap') AS cap_category, sum(value) AS v, count(*) AS n,
               count(*) FILTER (ms IS NOT NULL) AS l, count(*) FILTER (ms IS NULL) AS e FROM holdings LEFT JOIN m USING (security_id) JOIN w USING (stock_name) GROUP BY 1, 2, 3)
  SELECT portfolio_id, sector, cap_category, round(v, 2) AS cap_value, round(v / sum(v) OVER s, 6) AS cap_share,
         round(sum(v) OVER s / sum(v) OVER (PARTITION BY portfolio_id), 6) AS sector_weight, CAST(sum(n) OVER s AS BIGINT) AS sector_count,
         CAST(sum(l) OVER s AS BIGINT) AS live, CAST(sum(e) OVER s AS BIGINT) AS estimated FROM g WINDOW s AS (PARTITION BY portfolio_id, sector)""")
def _(spark, d):
    m = V.features(spark, d).filter("marketCap IS NOT NULL").select(
        F.col("symbol").alias("security_id"), F.col("sector").alias("market_sector"), R.cap_class_usd(F.col("marketCap")).alias("cap_category"))
    return P.sector_mix_detail(V.holdings(spark, d), m)
