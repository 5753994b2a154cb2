"""Queries: portfolio totals, stress tests, concentration and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lookups as L
from ..operators import portfolio as P
from ..operators import stress as S
from . import views as V
from .registry import query

COMP = """
  WITH s AS (SELECT portfolio_id, sector, sum(value) AS v FROM holdings GROUP BY 1, 2)
  SELECT portfolio_id, sector, v / sum(v) OVER (PARTITION BY portfolio_id) * 100 AS weight_pct,
         sum(v) OVER (PARTITION BY portfolio_id) AS portfolio_value FROM s"""
CONTRIB = """
  SELECT *, weight_frac * (baseline_pct * beta) AS contribution_pct, baseline_pct * beta AS adjusted_pct FROM (
    SELECT c.portfolio_id, i.scenario_key, c.sector, c.weight_pct / 100 AS weight_frac, portfolio_value,
           i.baseline_pct, coalesce(b.beta, 1.0::DOUBLE) AS beta
    FROM sql_comp c
    JOIN lk_scenario_impact i ON i.sector = CASE WHEN c.sector IN (SELECT sector FROM lk_scenario_impact) THEN c.sector ELSE 'Other' END
    LEFT JOIN lk_sector_beta b ON b.sector = c.sector)"""
IMPACT = """
  WITH d AS (SELECT portfolio_id, sum((weight_pct / 100) * (weight_pct / 100)) AS sq, min(portfolio_value) AS portfolio_value
             FROM sql_comp GROUP BY 1),
  e AS (SELECT portfolio_id, portfolio_value, round(sq * 10000, 2) AS hhi,
               round(greatest(0, least(1, 1 - sq)), 4) AS diversification_factor FROM d),
  g AS (SELECT portfolio_id, scenario_key, sum(contribution_pct) AS base,
               count(*) FILTER (abs(contribution_pct) > 1e-6) AS valid_contributions FROM sql_contrib GROUP BY 1, 2),
  m AS (SELECT g.*, portfolio_value, hhi, diversification_factor,
               CASE WHEN valid_contributions = 0 THEN 1.0::DOUBLE ELSE 1 + (1 - diversification_factor) * 0.2::DOUBLE END AS mult
        FROM g JOIN e USING (portfolio_id)),
  r AS (SELECT *, base * mult AS raw, valid_contributions > 0 AND abs(base * mult) < 0.25 AND abs(base) >= 0.025 AS floor_applied FROM m)
  SELECT portfolio_id, scenario_key, portfolio_value, hhi, diversification_factor, round(base, 4) AS base_impact,
         round(mult, 4) AS concentration_multiplier,
         round(CASE WHEN valid_contributions = 0 THEN 0.0::DOUBLE ELSE (1 - diversification_factor) * 0.2::DOUBLE END, 4) AS concentration_penalty,
         CASE WHEN valid_contributions = 0 THEN 0.0::DOUBLE WHEN floor_applied AND raw > 0 THEN 0.25::DOUBLE
              WHEN floor_applied THEN -0.25::DOUBLE ELSE round(raw, 4) END AS final_impact,
         floor_applied, valid_contributions,
         CASE WHEN valid_contributions = 0 THEN 'insufficient_contributions' ELSE '' END AS warning
  FROM r"""
EXPLAINED = """
  SELECT portfolio_id, scenario_key, final_impact AS impact_percentage, base_impact, hhi, diversification_factor,
         concentration_penalty, round(portfolio_value, 2) AS portfolio_value,
         CAST(round(CAST(abs(portfolio_value * (final_impact / 100)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS dollar_impact,
         CAST(round(CAST(portfolio_value * (1 + final_impact / 100) AS DECIMAL(38,9)), 2) AS DOUBLE) AS stressed_value,
         CASE WHEN abs(final_impact / 100) > 0.25 THEN 'Extreme' WHEN abs(final_impact / 100) > 0.15 THEN 'High'
              WHEN abs(final_impact / 100) > 0.08 THEN 'Medium' ELSE 'Low' END AS risk_level,
         round(greatest(abs(final_impact / 100) / 0.125::DOUBLE * 12, 1), 4) AS recovery_months,
         round(final_impact / 100 * 1.5::DOUBLE, 8) AS var_95
  FROM sql_impact"""

from .sql_views import VIEWS  # noqa: E402

VIEWS.update(sql_comp=COMP, sql_contrib=CONTRIB, sql_impact=IMPACT, sql_explained=EXPLAINED)


def stress_views(prefix: str, holdings: str) -> None:
    """The same views over other holdings (portfolio_id, sector, value), named sql_<prefix>_..."""
    for name, text in (("comp", COMP), ("contrib", CONTRIB), ("impact", IMPACT), ("explained", EXPLAINED)):
        text = text.replace("FROM holdings", f"FROM {holdings}")
        for other in ("comp", "contrib", "impact"):
            text = text.replace(f"sql_{other}", f"sql_{prefix}_{other}")
        VIEWS[f"sql_{prefix}_{name}"] = text


def explained(spark, d):
    return S.stress(V.holdings(spark, d))


def composition(spark, d):
    return S.sector_composition(V.holdings(spark, d))


@query("e1_portfolio_summary", """
  SELECT portfolio_id, round(sum(value), 2) AS total_value, round(sum(invested), 2) AS total_invested,
         round(sum(value) - sum(invested), 2) AS total_pnl,
         round(CASE WHEN sum(invested) > 0 THEN (sum(value) - sum(invested)) / sum(invested) * 100 ELSE 0 END, 4) AS pnl_pct,
         count(*) AS holdings FROM holdings GROUP BY 1""")
def _(spark, d):
    return P.portfolio_summary(V.holdings(spark, d))


@query("e2_sector_composition", """
  SELECT portfolio_id, sector, round(weight_pct, 6) AS weight_pct, 'value' AS basis FROM sql_comp""")
def _(spark, d):
    return composition(spark, d).select("portfolio_id", "sector", F.round("weight_pct", 6).alias("weight_pct"), "basis")


# portfolios whose values are missing take the next basis
@query("e2_sector_composition_fallback", """
  WITH h AS (SELECT portfolio_id, sector,
               CASE WHEN portfolio_id % 4 = 0 THEN value ELSE 0 END AS v, CASE WHEN portfolio_id % 4 = 1 THEN invested END AS i,
               CASE WHEN portfolio_id % 4 = 2 THEN quantity * coalesce(CASE WHEN security_id % 3 = 0 THEN avg_cost END, price) END AS e
             FROM holdings),
  s AS (SELECT portfolio_id, sector, sum(v) AS v, coalesce(sum(i), 0) AS i, coalesce(sum(e), 0) AS e FROM h GROUP BY 1, 2),
  t AS (SELECT *, sum(v) OVER p AS tv, sum(i) OVER p AS ti, sum(e) OVER p AS te, count(*) OVER p AS k FROM s
        WINDOW p AS (PARTITION BY portfolio_id))
  SELECT portfolio_id, sector,
         round(CASE WHEN tv > 0 THEN v / tv * 100 WHEN ti > 0 THEN i / ti * 100 WHEN te > 0 THEN e / te * 100 ELSE 100.0::DOUBLE / k END, 6) AS weight_pct,
         CASE WHEN tv > 0 THEN 'value' WHEN ti > 0 THEN 'invested' WHEN te > 0 THEN 'estimate' ELSE 'equal' END AS basis
  FROM t""")
def _(spark, d):
    p = F.col("portfolio_id") % 4
    h = V.holdings(spark, d).select(
        "portfolio_id", "sector", F.when(p == 0, F.col("value")).otherwise(0.0).alias("value"),
        F.when(p == 1, F.col("invested")).alias("invested"), F.when(p == 2, F.col("quantity")).alias("quantity"),
        F.when(F.col("security_id") % 3 == 0, F.col("avg_cost")).alias("avg_cost"), "price")
    return S.sector_composition(h).select("portfolio_id", "sector", F.round("weight_pct", 6).alias("weight_pct"), "basis")


@query("e3_diversification", """
  SELECT portfolio_id, round(sum((weight_pct / 100) * (weight_pct / 100)) * 10000, 2) AS hhi,
         round(greatest(0, least(1, 1 - sum((weight_pct / 100) * (weight_pct / 100)))), 4) AS diversification_factor
  FROM sql_comp GROUP BY 1""")
def _(spark, d):
    return S.diversification(composition(spark, d))


@query("e4_scenario_impact_by_sector", """
  SELECT portfolio_id, scenario_key, sector, round(weight_frac, 6) AS weight_frac, round(weight_frac * 100, 3) AS weight_pct,
         baseline_pct, beta, round(adjusted_pct, 3) AS adjusted_pct, round(contribution_pct, 4) AS contribution_pct
  FROM sql_contrib""")
def _(spark, d):
    return S.contribution_table(S.scenario_contributions(composition(spark, d)))


@query("d2_join_scenario", """
  SELECT portfolio_id, sector, round(weight_frac, 6) AS weight_frac, baseline_pct, beta FROM sql_contrib
  WHERE scenario_key = 'market_correction'""")
def _(spark, d):
    c = S.scenario_contributions(composition(spark, d)).filter(F.col("scenario_key") == "market_correction")
    return c.select("portfolio_id", "sector", F.round("weight_frac", 6).alias("weight_frac"), "baseline_pct", "beta")


@query("d2_join_all_scenarios", """
  SELECT portfolio_id, scenario_key, sector, round(weight_frac, 6) AS weight_frac, baseline_pct, beta FROM sql_contrib""")
def _(spark, d):
    c = S.scenario_contributions(composition(spark, d))
    return c.select("portfolio_id", "scenario_key", "sector", F.round("weight_frac", 6).alias("weight_frac"), "baseline_pct", "beta")


@query("d3_cross_scenarios", """
  SELECT portfolio_id, scenario_key, count(*) AS sectors, round(sum(weight_frac), 6) AS weight_sum
  FROM sql_contrib GROUP BY 1, 2""")
def _(spark, d):
    c = S.scenario_contributions(composition(spark, d))
    return c.groupBy("portfolio_id", "scenario_key").agg(
        F.count(F.lit(1)).alias("sectors"), F.round(F.sum("weight_frac"), 6).alias("weight_sum"))


@query("e5_scenario_impact", """
  SELECT portfolio_id, scenario_key, round(portfolio_value, 2) AS portfolio_value, hhi, diversification_factor, base_impact,
         concentration_multiplier, concentration_penalty, final_impact, floor_applied, valid_contributions, warning FROM sql_impact""")
def _(spark, d):
    x = S.scenario_impact(S.scenario_contributions(composition(spark, d)))
    return x.withColumn("portfolio_value", F.round("portfolio_value", 2))


@query("e6_explain_stress", "SELECT * FROM sql_explained")
def _(spark, d):
    return explained(spark, d)


_TITLE = "list_aggregate(list_transform(string_split(scenario_key, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"


@query("e7_compare_scenarios", f"""
  SELECT portfolio_id, {_TITLE} AS scenario, impact_percentage, risk_level, recovery_months FROM sql_explained""")
def _(spark, d):
    return S.compare_scenarios(explained(spark, d))


@query("g6_scenario_ranking", f"""
  SELECT portfolio_id, {_TITLE} AS scenario, impact_percentage, risk_level,
         CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY impact_percentage, scenario_key) AS INT) AS rank
  FROM sql_explained""")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("portfolio_id").orderBy("impact_percentage", "scenario_key")  # one row per scenario
    return explained(spark, d).select("portfolio_id", S.scenario_title(F.col("scenario_key")).alias("scenario"),
                                      "impact_percentage", "risk_level", F.row_number().over(w).alias("rank"))


@query("e8_scenario_extremes", """
  WITH x AS (SELECT e.*, s.ord FROM sql_explained e JOIN lk_scenario s USING (scenario_key)),
  g AS (SELECT portfolio_id, portfolio_value, arg_min(scenario_key, (impact_percentage, ord)) AS worst_scenario,
               min(impact_percentage) AS worst_impact, arg_max(scenario_key, (impact_percentage, -ord)) AS best_scenario,
               max(impact_percentage) AS best_impact, round(median(impact_percentage), 4) AS median_impact
        FROM x GROUP BY 1, 2)
  SELECT portfolio_id, worst_scenario, worst_impact, best_scenario, best_impact, median_impact,
         round(portfolio_value * abs(worst_impact) / 100, 2) AS worst_loss, round(portfolio_value * abs(best_impact) / 100, 2) AS best_loss,
         round(abs(worst_impact - best_impact), 4) AS impact_spread FROM g""")
def _(spark, d):
    return S.scenario_extremes(explained(spark, d))


_CUSTOM = [("IT Services", -0.30), ("Banking", -0.10), ("FMCG", -0.05), ("Pharmaceuticals", 0.0), ("Power", -0.20)]


def _custom(spark, d):
    imp = spark.createDataFrame(_CUSTOM, "sector string, sector_impact double")
    return S.apply_custom_scenario(V.holdings(spark, d), imp, -0.15)


VIEWS["sql_custom"] = ("SELECT h.*, coalesce(i.imp, -0.15::DOUBLE) AS sector_impact FROM holdings h LEFT JOIN (VALUES "
                       + ", ".join(f"('{s}', {v}::DOUBLE)" for s, v in _CUSTOM) + ") AS i(sector, imp) ON i.sector = h.sector")


@query("d6_apply_custom_scenario", """
  SELECT portfolio_id, holding_id, sector, sector_impact, round(value, 2) AS value,
         round(value * (1 + sector_impact), 4) AS stressed_value, round(value * (1 + sector_impact) - value, 4) AS loss
  FROM sql_custom""")
def _(spark, d):
    return _custom(spark, d).select(
        "portfolio_id", "holding_id", "sector", "sector_impact", F.round("value", 2).alias("value"),
        F.round("stressed_value", 4).alias("stressed_value"), F.round("loss", 4).alias("loss"))


@query("e10_sector_loss", """
  WITH g AS (SELECT portfolio_id, sector, sector_impact, sum(value) AS v, sum(value * (1 + sector_impact) - value) AS l
             FROM sql_custom GROUP BY 1, 2, 3)
  SELECT portfolio_id, sector, round(v, 2) AS value, CAST(round(CAST(l AS DECIMAL(38,9)), 2) AS DOUBLE) AS loss, round(sector_impact, 2) AS sector_impact,
         CAST(round(CAST(v / sum(v) OVER (PARTITION BY portfolio_id) * 100 AS DECIMAL(38,9)), 2) AS DOUBLE) AS weight_pct, CAST(round(CAST(l / v * 100 AS DECIMAL(38,9)), 2) AS DOUBLE) AS impact_pct FROM g""")
def _(spark, d):
    return S.sector_loss(_custom(spark, d))


@query("e9_scenario_ranges", """
  SELECT scenario_key, i.sectors, i.min_impact, i.max_impact, count(*) AS portfolios, min(impact_percentage) AS lowest, max(impact_percentage) AS highest
  FROM sql_explained e JOIN (SELECT scenario_key, count(sector) AS sectors, min(baseline_pct) AS min_impact, max(baseline_pct) AS max_impact
                             FROM lk_scenario_impact GROUP BY 1) i USING (scenario_key) GROUP BY ALL""")
def _(spark, d):
    # the ranges of the catalogue, and those of the impacts that portfolios get
    runs = explained(spark, d).groupBy("scenario_key").agg(F.count(F.lit(1)).alias("portfolios"), F.min("impact_percentage").alias("lowest"),
                                                           F.max("impact_percentage").alias("highest"))
    return runs.join(F.broadcast(S.scenario_ranges(spark)), "scenario_key").select(
        "scenario_key", "sectors", "min_impact", "max_impact", "portfolios", "lowest", "highest")


@query("e11_concentration", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY value DESC, holding_id) AS rn,
                    sum(value) OVER (PARTITION BY portfolio_id) AS tv FROM holdings),
  t AS (SELECT portfolio_id, tv, round(max(value) / tv * 100, 4) AS max_holding_pct,
               round(sum(value) FILTER (rn <= 5) / tv * 100, 4) AS top5_pct FROM r GROUP BY 1, 2),
  s AS (SELECT portfolio_id, sector, sum(value) AS v FROM holdings GROUP BY 1, 2),
  q AS (SELECT portfolio_id, round(sum(v * v) / (sum(v) * sum(v)) * 10000, 2) AS sector_hhi FROM s GROUP BY 1)
  SELECT portfolio_id, max_holding_pct, top5_pct, sector_hhi, max_holding_pct > 25 AS single_stock_warning,
         sector_hhi > 2500 AS sector_warning,
         CASE WHEN top5_pct > 50 THEN 'High concentration risk' WHEN top5_pct > 30 THEN 'Moderate concentration' ELSE 'Well diversified' END AS top5_band,
         CASE WHEN sector_hhi < 1500 THEN 'Excellent' WHEN sector_hhi < 2500 THEN 'Good' ELSE 'Moderate' END AS hhi_grade
  FROM t JOIN q USING (portfolio_id)""")
def _(spark, d):
    return P.concentration(V.holdings(spark, d))


VIEWS["sql_components"] = """
  WITH s AS (SELECT portfolio_id, sector, sum(value) AS v, sum(value * value) AS sq, count(*) AS n FROM holdings GROUP BY 1, 2),
  t AS (SELECT portfolio_id, sum(v) AS tv, sum(sq) AS sq, sum(n) AS n, max(v) AS mx FROM s GROUP BY 1)
  SELECT portfolio_id, round(least(greatest((sq / (tv * tv) - 0.1::DOUBLE) * 10, 0), 5), 6) AS concentration_penalty,
         CASE WHEN n >= 20 THEN -2.0::DOUBLE WHEN n >= 15 THEN -1.5 WHEN n >= 10 THEN -1.0 WHEN n >= 5 THEN -0.5 ELSE 0.0 END AS diversification_benefit,
         CASE WHEN mx / tv > 0.5 THEN 3.0::DOUBLE WHEN mx / tv > 0.3 THEN 2.0 ELSE 1.0 END AS sector_risk FROM t"""


@query("e12_risk_components", "SELECT * FROM sql_components")
def _(spark, d):
    return P.risk_components(V.holdings(spark, d))


_PARTIAL = """
  SELECT n.stock_name, coalesce((SELECT sector FROM (
      SELECT k.sector, k.ord, sum(CASE WHEN contains(upper(trim(n.stock_name)), k.keyword) THEN 2 ELSE 0 END
        + CASE WHEN len(list_filter(string_split(k.keyword, ' '), lambda w: contains(upper(trim(n.stock_name)), w))) > 0 THEN 1 ELSE 0 END) AS sc
      FROM lk_partial_keyword k GROUP BY 1, 2 HAVING sc > 0 ORDER BY sc DESC, ord LIMIT 1)), 'Other') AS sector
  FROM (SELECT DISTINCT stock_name FROM holdings) n"""
VIEWS["sql_name_partial"] = _PARTIAL


@query("e13_impact_scatter", """
  WITH s AS (SELECT h.portfolio_id, p.sector, sum(value) AS value FROM holdings h JOIN sql_name_partial p USING (stock_name) GROUP BY 1, 2),
  x AS (SELECT s.*, value / sum(value) OVER (PARTITION BY portfolio_id) * 100 AS exposure, abs(i.impact * 100) AS impact_pct
        FROM s JOIN lk_scenario_impact_coarse i ON i.sector = s.sector AND i.scenario_key = 'recession_scenario'),
  y AS (SELECT *, median(exposure) OVER (PARTITION BY portfolio_id) AS me, median(impact_pct) OVER (PARTITION BY portfolio_id) AS mi FROM x)
  SELECT portfolio_id, sector, round(value, 2) AS value, round(exposure, 4) AS exposure_pct, round(impact_pct, 4) AS impact_pct,
         round(me, 4) AS median_exposure, round(mi, 4) AS median_impact,
         CASE WHEN round(exposure, 9) >= round(me, 9) THEN 'High' ELSE 'Low' END || ' Exposure, ' ||
         CASE WHEN round(impact_pct, 9) >= round(mi, 9) THEN 'High' ELSE 'Low' END || ' Risk' AS quadrant FROM y""")
def _(spark, d):
    return S.impact_scatter(V.holdings(spark, d), "recession_scenario")


_CAT = """
  SELECT n.stock_name, coalesce(
      (SELECT arg_min(a.category, a.ord) FROM lk_asset_category a WHERE contains(upper(trim(n.stock_name)), a.keyword)
                                                                   OR contains(a.keyword, upper(trim(n.stock_name)))),
      (SELECT arg_min(c.category, c.ord) FROM lk_category_keyword c WHERE contains(lower(n.stock_name), c.keyword)),
      'large_cap_stocks') AS category
  FROM (SELECT DISTINCT stock_name FROM holdings) n"""
VIEWS["sql_name_category"] = _CAT
VIEWS["sql_category_weights"] = """
  WITH c AS (SELECT portfolio_id, category, sum(value) AS v, count(*) AS n FROM holdings JOIN sql_name_category USING (stock_name) GROUP BY 1, 2)
  SELECT *, v / sum(v) OVER (PARTITION BY portfolio_id) AS wt FROM c"""


@query("e15_category_weights", """
  SELECT portfolio_id, category, n AS holdings, round(v, 2) AS value, round(wt, 6) AS weight,
         round(sum(wt * wt) OVER (PARTITION BY portfolio_id), 6) AS concentration_risk FROM sql_category_weights""")
def _(spark, d):
    c = P.category_weights(V.holdings(spark, d), C.categorize_asset)
    return c.select("portfolio_id", "category", F.col("n").alias("holdings"), F.round("v", 2).alias("value"),
                    F.round("wt", 6).alias("weight"), F.round("hhi", 6).alias("concentration_risk"))


@query("e16_legacy_stress", """
  WITH r AS (SELECT portfolio_id, sum(wt * CASE category WHEN 'tech_stocks' THEN -0.3::DOUBLE ELSE -0.05::DOUBLE END) AS raw
             FROM sql_category_weights GROUP BY 1),
  x AS (SELECT portfolio_id, CASE WHEN abs(raw) >= 0.005 THEN raw WHEN raw > 0 THEN 0.005::DOUBLE ELSE -0.005::DOUBLE END AS t FROM r)
  SELECT portfolio_id, round(t, 6) AS total_impact, round(t * 100, 4) AS impact_percentage,
         CASE WHEN round(abs(t), 9) > 0.25 THEN 'Extreme' WHEN round(abs(t), 9) > 0.15 THEN 'High' WHEN round(abs(t), 9) > 0.08 THEN 'Medium' ELSE 'Low' END AS risk_level,
         round(greatest(abs(t) / 0.125::DOUBLE * 12, 1), 4) AS recovery_months, round(t * 1.5::DOUBLE, 6) AS var_95 FROM x""")
def _(spark, d):
    return S.legacy_stress(P.category_weights(V.holdings(spark, d), C.categorize_asset), {"tech_stocks": -0.3})


@query("e31_scenario_heatmap", """
  SELECT scenario_key, round(coalesce(avg(impact_percentage) FILTER (risk_level = 'Low'), 0), 4) AS low,
         round(coalesce(avg(impact_percentage) FILTER (risk_level = 'Medium'), 0), 4) AS medium,
         round(coalesce(avg(impact_percentage) FILTER (risk_level = 'High'), 0), 4) AS high,
         round(coalesce(avg(impact_percentage) FILTER (risk_level = 'Extreme'), 0), 4) AS extreme
  FROM sql_explained GROUP BY 1""")
def _(spark, d):
    return S.scenario_heatmap(explained(spark, d))


@query("e32_risk_level_counts", "SELECT scenario_key, risk_level, count(*) AS portfolios FROM sql_explained GROUP BY 1, 2")
def _(spark, d):
    return S.risk_level_counts(explained(spark, d))


def _waterfall_sql(base):
    return f"""
  WITH j AS (SELECT portfolio_id, scenario_key, {base} AS b, c.concentration_penalty AS c, sector_risk AS s, diversification_benefit AS d
             FROM sql_explained e JOIN sql_components c USING (portfolio_id))
  SELECT portfolio_id, scenario_key, 1 AS step, 'Base Scenario' AS component, round(b, 4) AS value, round(b, 4) AS cumulative FROM j
  UNION ALL SELECT portfolio_id, scenario_key, 2, 'Concentration Risk', round(c, 4), round(b + c, 4) FROM j
  UNION ALL SELECT portfolio_id, scenario_key, 3, 'Sector Risk', s, round(b + c + s, 4) FROM j
  UNION ALL SELECT portfolio_id, scenario_key, 4, 'Diversification', d, round(b + c + s + d, 4) FROM j"""


def _waterfall(spark, d, loss_scale):
    h = V.holdings(spark, d)
    comps = P.risk_components(h).withColumnRenamed("concentration_penalty", "concentration_penalty_pts")
    return S.risk_waterfall(S.stress(h), comps, loss_scale)


@query("f6_risk_waterfall", _waterfall_sql("impact_percentage"))
def _(spark, d):
    return _waterfall(spark, d, False)


@query("f6_risk_waterfall_loss_scale", _waterfall_sql("abs(impact_percentage)"))
def _(spark, d):
    return _waterfall(spark, d, True)


VIEWS["sql_curve"] = """
  WITH e AS (SELECT portfolio_id, scenario_key, greatest(CAST(floor(recovery_months) AS INT), 1) AS rec,
                    CASE WHEN abs(impact_percentage) >= 0.1 THEN impact_percentage WHEN impact_percentage > 0 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END AS imp
             FROM sql_explained)
  SELECT portfolio_id, scenario_key, rec, imp, CAST(m AS INT) AS month,
         100 + imp * exp(-m / greatest(rec / 3.0::DOUBLE, 0.5::DOUBLE)) AS level
  FROM e, unnest(range(0, least(rec + 6, 36))) AS u(m)"""


@query("f8_recovery_curve", "SELECT portfolio_id, scenario_key, month, round(level, 4) AS level FROM sql_curve")
def _(spark, d):
    return S.recovery_curve(explained(spark, d)).select("portfolio_id", "scenario_key", "month", F.round("level", 4).alias("level"))


@query("f8_recovery_milestones", """
  SELECT portfolio_id, scenario_key, rec AS months_100,
         coalesce(min(month) FILTER (round(level, 9) >= round(100 + imp * 0.75::DOUBLE, 9)), rec) AS months_25,
         coalesce(min(month) FILTER (round(level, 9) >= round(100 + imp * 0.5::DOUBLE, 9)), rec) AS months_50
  FROM sql_curve GROUP BY portfolio_id, scenario_key, rec""")
def _(spark, d):
    return S.recovery_milestones(S.recovery_curve(explained(spark, d)))


@query("e48_limit_breaches", """
  WITH w AS (SELECT portfolio_id, 'holding' AS grain, holding_id AS item, value / sum(value) OVER (PARTITION BY portfolio_id) * 100 AS weight_pct FROM holdings),
  s AS (SELECT portfolio_id, 'sector' AS grain, sector AS item, weight_pct FROM sql_comp),
  t AS (SELECT profile, max(value) FILTER (name = 'concentration_warning') AS hw, max(value) FILTER (name = 'concentration_critical') AS hc,
               max(value) FILTER (name = 'sector_concentration_warning') AS sw, max(value) FILTER (name = 'max_sector_exposure') AS sc
        FROM lk_risk_threshold GROUP BY 1)
  SELECT portfolio_id, profile, grain, item, round(weight_pct, 4) AS weight_pct,
         CASE WHEN weight_pct > CASE grain WHEN 'holding' THEN hc ELSE sc END THEN 'critical' ELSE 'warning' END AS status
  FROM (SELECT * FROM w UNION ALL SELECT * FROM s) x JOIN t ON weight_pct > CASE grain WHEN 'holding' THEN hw ELSE sw END""")
def _(spark, d):
    return P.limit_breaches(V.holdings(spark, d), L.lookup(spark, "risk_threshold"))


@query("f5_weight_share", """
  SELECT portfolio_id, holding_id, round(value / sum(value) OVER (PARTITION BY portfolio_id) * 100, 6) AS weight_pct FROM holdings""")
def _(spark, d):
    return P.weights(V.holdings(spark, d)).select("portfolio_id", "holding_id", F.round(F.col("weight") * 100, 6).alias("weight_pct"))


VIEWS["sql_ranked"] = """
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY value DESC, holding_id) AS rn,
         sum(value) OVER (PARTITION BY portfolio_id) AS tv FROM holdings"""
_TOP8 = """
  SELECT portfolio_id, CAST(least(rn, 9) AS INT) AS rn, CASE WHEN rn <= 8 THEN holding_id ELSE '' END AS holding_id,
         CASE WHEN rn <= 8 THEN stock_name ELSE 'Others' END AS stock_name,
         round(sum(value), 2) AS value, round(sum(value) / min(tv) * 100, 4) AS percentage
  FROM sql_ranked GROUP BY 1, 2, 3, 4"""


@query("g1_top8_plus_others", _TOP8)
def _(spark, d):
    return P.top_plus_others(V.holdings(spark, d), 8)


@query("h1_append_rows", """
  SELECT portfolio_id, sector, round(weight_pct, 6) AS weight_pct FROM sql_comp
  UNION ALL SELECT portfolio_id, 'All sectors', round(sum(weight_pct), 6) FROM sql_comp GROUP BY 1""")
def _(spark, d):
    comp = composition(spark, d).select("portfolio_id", "sector", "weight_pct")
    total = comp.groupBy("portfolio_id").agg(F.sum("weight_pct").alias("weight_pct")).withColumn("sector", F.lit("All sectors"))
    return comp.unionByName(total).select("portfolio_id", "sector", F.round("weight_pct", 6).alias("weight_pct"))


@query("g2_top5_holdings", """
  SELECT portfolio_id, CAST(rn AS INT) AS rn, holding_id, stock_name, round(value, 2) AS value, round(value / tv * 100, 4) AS weight_pct
  FROM sql_ranked WHERE rn <= 5""")
def _(spark, d):
    return P.top_with_weight(V.holdings(spark, d), 5)


@query("g4_top3_sectors", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(weight_pct, 9) DESC, sector) AS rn FROM sql_comp)
  SELECT portfolio_id, string_agg(sector || ' (' || CAST(round(weight_pct, 1) AS DECIMAL(18,1)) || '%)', ', ' ORDER BY rn) AS top_sectors
  FROM r WHERE rn <= 3 GROUP BY 1""")
def _(spark, d):
    return S.top3_sectors(composition(spark, d))


@query("h2_distinct_sectors", "SELECT DISTINCT portfolio_id, sector FROM holdings")
def _(spark, d):
    return P.distinct_sectors(V.holdings(spark, d))


@query("c32_list_scenarios", """
  SELECT s.*, count(e.portfolio_id) AS portfolios FROM (SELECT scenario_key, name, description, probability FROM lk_scenario) s
  LEFT JOIN sql_explained e USING (scenario_key) GROUP BY ALL""")
def _(spark, d):
    ran = explained(spark, d).groupBy("scenario_key").agg(F.count(F.lit(1)).alias("portfolios"))
    return (ran.join(F.broadcast(L.lookup(spark, "scenario").drop("ord")), "scenario_key")
            .select("scenario_key", "name", "description", "probability", "portfolios"))


@query("c32_get_scenario", """
  WITH r AS (SELECT c_custkey AS portfolio_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'credit_crisis' WHEN c_custkey % 2 = 0 THEN 'inflation_spike'
                    ELSE 'tech_sector_crash' END AS scenario_key FROM customer)
  SELECT r.portfolio_id, r.scenario_key, s.scenario_key IS NULL AS is_fallback, coalesce(s.scenario_key, 'market_correction') AS used_key,
         coalesce(s.name, 'Market Correction') AS name, coalesce(s.probability, 0.4::DOUBLE) AS probability
  FROM r LEFT JOIN lk_scenario s USING (scenario_key)""")
def _(spark, d):
    c = V.table(spark, d, "customer")
    req = c.select(F.col("c_custkey").alias("portfolio_id"), F.when(F.col("c_mktsegment") == "BUILDING", "credit_crisis")
                   .when(F.col("c_custkey") % 2 == 0, "inflation_spike").otherwise("tech_sector_crash").alias("scenario_key"))
    return S.get_scenarios(req).select("portfolio_id", "scenario_key", "is_fallback", "used_key", "name", "probability")


# sector given or inferred, on holdings with gaps
@query("e6_explain_stress_inferred", """
  WITH o AS (SELECT n.stock_name, coalesce((SELECT arg_min(c.sector, c.ord) FROM lk_company_sector c WHERE contains(upper(n.stock_name), c.keyword)),
               (SELECT sector FROM (SELECT k.sector, k.ord, sum(CASE WHEN contains(upper(n.stock_name), k.keyword) THEN k.weight ELSE 0 END) AS sc
                 FROM lk_sector_keyword k GROUP BY 1, 2 HAVING sc > 0 ORDER BY sc DESC, ord LIMIT 1)), 'Other') AS inferred
             FROM (SELECT DISTINCT stock_name FROM holdings) n),
  s AS (SELECT portfolio_id, CASE WHEN security_id % 3 = 0 THEN inferred ELSE sector END AS sector, sum(value) AS v
        FROM holdings JOIN o USING (stock_name) GROUP BY 1, 2)
  SELECT portfolio_id, sector, round(v / sum(v) OVER (PARTITION BY portfolio_id) * 100, 6) AS weight_pct FROM s""")
def _(spark, d):
    h = V.holdings(spark, d).withColumn("sector", F.when(F.col("security_id") % 3 != 0, F.col("sector")))
    comp = S.sector_composition(S.with_given_or_inferred_sector(h))
    return comp.select("portfolio_id", "sector", F.round("weight_pct", 6).alias("weight_pct"))


VIEWS["sql_inferred_holdings"] = """
  WITH n AS (SELECT DISTINCT stock_name FROM holdings),
  k AS (SELECT stock_name, c.ord, c.sector, sum(c.weight) AS sc FROM n JOIN lk_sector_keyword c ON contains(upper(stock_name), c.keyword) GROUP BY ALL),
  w AS (SELECT n.stock_name, coalesce((SELECT arg_min(o.sector, o.ord) FROM lk_company_sector o WHERE contains(upper(n.stock_name), o.keyword)),
               (SELECT arg_max(k.sector, (k.sc, -k.ord)) FROM k WHERE k.stock_name = n.stock_name), 'Other') AS inferred FROM n)
  SELECT portfolio_id, CASE WHEN security_id % 3 = 0 THEN inferred ELSE sector END AS sector, value FROM holdings JOIN w USING (stock_name)"""
stress_views("inferred", "sql_inferred_holdings")


@query("e6_stress_of_inferred", "SELECT * FROM sql_inferred_explained")
def _(spark, d):
    h = V.holdings(spark, d).withColumn("sector", F.when(F.col("security_id") % 3 != 0, F.col("sector")))
    return S.stress(S.with_given_or_inferred_sector(h))
