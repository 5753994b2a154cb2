"""Scenario stress tests for all portfolios at once.

Holdings are first summed to (portfolio, sector): a few dozen rows per portfolio whatever its size.
Everything after works on that small table: weights, HHI, then an equi-join with the scenario matrix on
the sector, which yields one row per scenario without a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lookups as L
from ..functions import ratings as R
from ..functions import skew


def _by_portfolio():
    """Only used over (portfolio, sector) rows, never over holdings."""
    return Window.partitionBy("portfolio_id")


def sector_composition(h: DataFrame) -> DataFrame:
    """Sector weights in percent, from the first basis with a total: value, invested, estimate, equal.

    Takes portfolio_id, sector, value, invested, quantity, avg_cost, price.
    """
    unit = F.coalesce("avg_cost", "price")
    est = F.when((F.col("quantity") > 0) & (unit > 0), F.col("quantity") * unit)
    plus = lambda c: F.when(c > 0, c)
    s = h.groupBy("portfolio_id", "sector").agg(
        F.coalesce(F.sum(plus(F.col("value"))), F.lit(0.0)).alias("v"),
        F.coalesce(F.sum(plus(F.col("invested"))), F.lit(0.0)).alias("i"),
        F.coalesce(F.sum(est), F.lit(0.0)).alias("e"))
    s = s.select("*", *[F.sum(c).over(_by_portfolio()).alias("t" + c) for c in "vie"],
                 F.count(F.lit(1)).over(_by_portfolio()).alias("k"))
    basis = (F.when(F.col("tv") > 0, "value").when(F.col("ti") > 0, "invested")
             .when(F.col("te") > 0, "estimate").otherwise("equal"))
    pct = (F.when(F.col("tv") > 0, F.col("v") / F.col("tv")).when(F.col("ti") > 0, F.col("i") / F.col("ti"))
           .when(F.col("te") > 0, F.col("e") / F.col("te")).otherwise(1.0 / F.col("k"))) * 100
    return (s.select("portfolio_id", "sector", pct.alias("weight_pct"), basis.alias("basis"),
                     F.when(F.col("tv") > 0, F.col("tv")).alias("portfolio_value"))
            .filter("weight_pct > 0"))


def with_given_or_inferred_sector(h: DataFrame) -> DataFrame:
    """The given sector, else the one the stock name suggests (only computed where it is missing)."""
    return h.withColumn("sector", F.coalesce(F.when(F.trim("sector") != "", F.col("sector")),
                                             C.infer_sector(F.coalesce("stock_name", F.lit("")))))


def _hhi_factor(sum_of_squares: Column) -> tuple[Column, Column]:
    return (F.round(sum_of_squares * 10000, 2),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sum_of_squares)), 4))


def diversification(comp: DataFrame) -> DataFrame:
    """HHI (0..10000) and diversification factor per portfolio."""
    f = F.col("weight_pct") / 100
    hhi, factor = _hhi_factor(F.col("sq"))
    return comp.groupBy("portfolio_id").agg(F.sum(f * f).alias("sq")).select(
        "portfolio_id", hhi.alias("hhi"), factor.alias("diversification_factor"))


def scenario_grid(spark: SparkSession, matrix: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(matrix_sector, scenario_key, baseline_pct, beta): complete, with gaps filled from Other."""
    if matrix is None:
        matrix = {k: dict(zip(L.MATRIX_SECTORS, v)) for k, v in L.SCENARIO_IMPACT.items()}
    sectors = sorted({s for m in matrix.values() for s in m} | {"Other"})
    rows = [(s, k, float(m.get(s, m.get("Other", -10)))) for k, m in matrix.items() for s in sectors]
    return spark.createDataFrame(rows, "matrix_sector string, scenario_key string, baseline_pct double")


def default_grid(spark: SparkSession) -> DataFrame:
    """The fixed matrix as a local relation (all sectors are given for all scenarios)."""
    return L.lookup(spark, "scenario_impact").withColumnRenamed("sector", "matrix_sector")


def scenario_contributions(comp: DataFrame, grid: DataFrame | None = None,
                           known_sectors: list[str] | None = None) -> DataFrame:
    """One unrounded row per portfolio, scenario and sector."""
    spark = comp.sparkSession
    grid = F.broadcast(default_grid(spark)) if grid is None else skew.small_side(grid)
    known = L.MATRIX_SECTORS if known_sectors is None else known_sectors
    f = F.col("weight_pct") / 100
    hhi, factor = _hhi_factor(F.sum(f * f).over(_by_portfolio()))
    c = comp.select("portfolio_id", "sector", "portfolio_value", f.alias("weight_frac"),
                    hhi.alias("hhi"), factor.alias("diversification_factor"),
                    F.when(F.col("sector").isin(known), F.col("sector")).otherwise("Other").alias("matrix_sector"))
    j = (c.join(F.broadcast(L.lookup(spark, "sector_beta")), "sector", "left")
         .join(grid, "matrix_sector"))
    beta = F.coalesce("beta", F.lit(1.0))
    return j.select("portfolio_id", "scenario_key", "sector", "weight_frac", "portfolio_value", "hhi",
                    "diversification_factor", "baseline_pct", beta.alias("beta"),
                    (F.col("baseline_pct") * beta).alias("adjusted_pct"),
                    (F.col("weight_frac") * (F.col("baseline_pct") * beta)).alias("contribution_pct"))


def contribution_table(contrib: DataFrame) -> DataFrame:
    return contrib.select(
        "portfolio_id", "scenario_key", "sector", F.round("weight_frac", 6).alias("weight_frac"),
        F.round(F.col("weight_frac") * 100, 3).alias("weight_pct"), "baseline_pct", "beta",
        F.round("adjusted_pct", 3).alias("adjusted_pct"), F.round("contribution_pct", 4).alias("contribution_pct"))


FLOOR_PCT = 0.25


def scenario_impact(contrib: DataFrame) -> DataFrame:
    """Base and final impact (percent) per portfolio and scenario."""
    g = contrib.groupBy("portfolio_id", "scenario_key", "hhi", "diversification_factor", "portfolio_value").agg(
        F.sum("contribution_pct").alias("base"),
        F.count_if(F.abs("contribution_pct") > 1e-6).alias("valid_contributions"))
    none = F.col("valid_contributions") == 0
    mult = F.when(none, 1.0).otherwise(1 + (1 - F.col("diversification_factor")) * 0.2)
    g = g.withColumn("mult", mult).withColumn("raw", F.col("base") * F.col("mult"))
    floored = ~none & (F.abs("raw") < FLOOR_PCT) & (F.abs("base") >= FLOOR_PCT / 10)
    final = (F.when(none, 0.0).when(floored & (F.col("raw") > 0), FLOOR_PCT).when(floored, -FLOOR_PCT)
             .otherwise(F.round("raw", 4)))
    return g.select(
        "portfolio_id", "scenario_key", "portfolio_value", "hhi", "diversification_factor",
        F.round("base", 4).alias("base_impact"), F.round("mult", 4).alias("concentration_multiplier"),
        F.round(F.when(none, 0.0).otherwise((1 - F.col("diversification_factor")) * 0.2), 4).alias("concentration_penalty"),
        final.alias("final_impact"), floored.alias("floor_applied"), "valid_contributions",
        F.when(none, "insufficient_contributions").otherwise("").alias("warning"))


def explain_stress(impacts: DataFrame) -> DataFrame:
    """Money amounts, level, recovery time and VaR proxy for each impact row."""
    frac = F.col("final_impact") / 100
    a = F.abs(frac)
    return impacts.select(
        "portfolio_id", "scenario_key", F.col("final_impact").alias("impact_percentage"), "base_impact", "hhi",
        "diversification_factor", "concentration_penalty",
        F.round("portfolio_value", 2).alias("portfolio_value"),
        R.round_half_up(F.abs(F.col("portfolio_value") * frac), 2).alias("dollar_impact"),
        R.round_half_up(F.col("portfolio_value") * (1 + frac), 2).alias("stressed_value"),
        R.stress_risk_level(a).alias("risk_level"), F.round(R.recovery_months(a), 4).alias("recovery_months"),
        F.round(R.var95_proxy(frac), 8).alias("var_95"))


def stress(h: DataFrame, grid: DataFrame | None = None, known_sectors: list[str] | None = None) -> DataFrame:
    """Holdings to explained stress results for every scenario of the grid."""
    return explain_stress(scenario_impact(scenario_contributions(sector_composition(h), grid, known_sectors)))


def scenario_title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def compare_scenarios(explained: DataFrame) -> DataFrame:
    return explained.select("portfolio_id", scenario_title(F.col("scenario_key")).alias("scenario"),
                            "impact_percentage", "risk_level", "recovery_months")


def scenario_extremes(explained: DataFrame) -> DataFrame:
    """Worst, best and median scenario per portfolio (ties to the first scenario of the catalogue)."""
    order = F.broadcast(L.lookup(explained.sparkSession, "scenario").select("scenario_key", "ord"))
    x = explained.join(order, "scenario_key")
    g = x.groupBy("portfolio_id", "portfolio_value").agg(
        F.min(F.struct("impact_percentage", "ord", "scenario_key")).alias("w"),
        F.max(F.struct("impact_percentage", (-F.col("ord")).alias("o"), "scenario_key")).alias("b"),
        F.median("impact_percentage").alias("median_impact"))
    wi, bi, v = F.col("w.impact_percentage"), F.col("b.impact_percentage"), F.col("portfolio_value")
    return g.select("portfolio_id", F.col("w.scenario_key").alias("worst_scenario"), wi.alias("worst_impact"),
                    F.col("b.scenario_key").alias("best_scenario"), bi.alias("best_impact"),
                    F.round("median_impact", 4).alias("median_impact"),
                    F.round(v * F.abs(wi) / 100, 2).alias("worst_loss"),
                    F.round(v * F.abs(bi) / 100, 2).alias("best_loss"),
                    F.round(F.abs(wi - bi), 4).alias("impact_spread"))


def scenario_ranges(spark: SparkSession) -> DataFrame:
    return L.lookup(spark, "scenario_impact").groupBy("scenario_key").agg(
        F.count("sector").alias("sectors"), F.min("baseline_pct").alias("min_impact"),
        F.max("baseline_pct").alias("max_impact"))


def get_scenarios(requests: DataFrame) -> DataFrame:
    """Catalogue rows for requested keys; unknown keys get the default scenario and say so."""
    spark = requests.sparkSession
    cat = F.broadcast(L.lookup(spark, "scenario").withColumnRenamed("scenario_key", "used_key"))
    known = F.col("scenario_key").isin([s[0] for s in L.SCENARIOS])
    r = requests.withColumn("is_fallback", ~F.coalesce(known, F.lit(False))).withColumn(
        "used_key", F.when(F.col("is_fallback"), F.lit(L.DEFAULT_SCENARIO)).otherwise(F.col("scenario_key")))
    return r.join(cat, "used_key").drop("ord")


# user scenarios --------------------------------------------------------------------------------
def apply_custom_scenario(h: DataFrame, impacts: DataFrame, equity_impact: float) -> DataFrame:
    """Stressed value and loss per holding; ``impacts`` is (sector, sector_impact) fractions."""
    j = h.join(skew.small_side(impacts), "sector", "left")
    imp = F.coalesce("sector_impact", F.lit(equity_impact))
    return j.select(*h.columns, imp.alias("sector_impact"), (F.col("value") * (1 + imp)).alias("stressed_value"),
                    (F.col("value") * (1 + imp) - F.col("value")).alias("loss"))


def sector_loss(stressed: DataFrame) -> DataFrame:
    g = stressed.groupBy("portfolio_id", "sector", "sector_impact").agg(
        F.sum("value").alias("v"), F.sum("loss").alias("l"))
    return g.select("portfolio_id", "sector", F.round("v", 2).alias("value"), R.round_half_up(F.col("l"), 2).alias("loss"),
                    F.round("sector_impact", 2).alias("sector_impact"),
                    R.round_half_up(F.col("v") / F.sum("v").over(_by_portfolio()) * 100, 2).alias("weight_pct"),
                    R.round_half_up(F.col("l") / F.col("v") * 100, 2).alias("impact_pct"))


def legacy_stress(category_weights: DataFrame, factors: dict[str, float], default: float = -0.05) -> DataFrame:
    """Impact by asset category with a default factor, and a smallest impact of half a percent."""
    factor = F
    for k, v in factors.items():
        factor = factor.when(F.col("category") == k, F.lit(v))
    g = category_weights.groupBy("portfolio_id").agg(F.sum(F.col("wt") * factor.otherwise(F.lit(default))).alias("raw"))
    x = F.when(F.abs("raw") >= 0.005, F.col("raw")).when(F.col("raw") > 0, 0.005).otherwise(-0.005)
    g = g.withColumn("total_impact", x)
    a = F.abs("total_impact")
    return g.select("portfolio_id", F.round("total_impact", 6).alias("total_impact"),
                    F.round(F.col("total_impact") * 100, 4).alias("impact_percentage"),
                    R.stress_risk_level(F.round(a, 9)).alias("risk_level"),
                    F.round(R.recovery_months(a), 4).alias("recovery_months"),
                    F.round(R.var95_proxy(F.col("total_impact")), 6).alias("var_95"))


# charts' data ----------------------------------------------------------------------------------
def impact_scatter(h: DataFrame, scenario_key: str) -> DataFrame:
    """Exposure against expected impact by coarse sector, with the quadrant of each point."""
    spark = h.sparkSession
    key = scenario_key if scenario_key in L.SCENARIO_IMPACT_COARSE else L.DEFAULT_SCENARIO
    by_name = h.filter("value > 0").groupBy("portfolio_id", "stock_name").agg(F.sum("value").alias("value"))
    named = skew.map_distinct(by_name, "stock_name", "sector", C.infer_sector_partial, ["portfolio_id"])
    impact = L.lookup(spark, "scenario_impact_coarse").filter(F.col("scenario_key") == key).select("sector", "impact")
    s = named.groupBy("portfolio_id", "sector").agg(F.sum("value").alias("value")).join(F.broadcast(impact), "sector")
    x = s.select("portfolio_id", "sector", F.round("value", 2).alias("value"),
                 (F.col("value") / F.sum("value").over(_by_portfolio()) * 100).alias("exposure"),
                 F.abs(F.col("impact") * 100).alias("impact_pct"))
    x = x.withColumn("me", F.median("exposure").over(_by_portfolio())).withColumn("mi", F.median("impact_pct").over(_by_portfolio()))
    high_e, high_i = F.round("exposure", 9) >= F.round("me", 9), F.round("impact_pct", 9) >= F.round("mi", 9)
    return x.select(
        "portfolio_id", "sector", "value", F.round("exposure", 4).alias("exposure_pct"),
        F.round("impact_pct", 4).alias("impact_pct"), F.round("me", 4).alias("median_exposure"),
        F.round("mi", 4).alias("median_impact"),
        F.concat(F.when(high_e, "High").otherwise("Low"), F.lit(" Exposure, "),
                 F.when(high_i, "High").otherwise("Low"), F.lit(" Risk")).alias("quadrant"))


def scenario_heatmap(explained: DataFrame) -> DataFrame:
    """Mean impact by scenario and risk level, 0 where a level does not occur."""
    levels = ["Low", "Medium", "High", "Extreme"]
    p = explained.groupBy("scenario_key").pivot("risk_level", levels).agg(F.avg("impact_percentage"))
    return p.select("scenario_key", *[F.round(F.coalesce(F.col(x), F.lit(0.0)), 4).alias(x.lower()) for x in levels])


def risk_level_counts(explained: DataFrame) -> DataFrame:
    return explained.groupBy("scenario_key", "risk_level").agg(F.count(F.lit(1)).alias("portfolios"))


def risk_waterfall(explained: DataFrame, components: DataFrame, loss_scale: bool = False) -> DataFrame:
    """Four steps from base impact to total. ``loss_scale`` counts losses as positive numbers."""
    base = F.abs("impact_percentage") if loss_scale else F.col("impact_percentage")
    j = explained.join(components, "portfolio_id").select(
        "portfolio_id", "scenario_key", base.alias("b"), F.col("concentration_penalty_pts").alias("c"),
        F.col("sector_risk").alias("s"), F.col("diversification_benefit").alias("d"))
    b, c, s, d = (F.col(x) for x in "bcsd")
    step = lambda n, name, v, cum: F.struct(F.lit(n).alias("step"), F.lit(name).alias("component"),
                                            v.alias("value"), cum.alias("cumulative"))
    rows = F.array(step(1, "Base Scenario", b, b), step(2, "Concentration Risk", c, b + c),
                   step(3, "Sector Risk", s, b + c + s), step(4, "Diversification", d, b + c + s + d))
    return j.select("portfolio_id", "scenario_key", F.explode(rows).alias("r")).select(
        "portfolio_id", "scenario_key", "r.step", "r.component", F.round("r.value", 4).alias("value"),
        F.round("r.cumulative", 4).alias("cumulative"))


def recovery_curve(explained: DataFrame) -> DataFrame:
    """Expected level (100 = before) per month, at most 36 months."""
    imp = F.when(F.abs("impact_percentage") >= 0.1, F.col("impact_percentage")).when(
        F.col("impact_percentage") > 0, 0.1).otherwise(-0.1)
    rec = F.greatest(F.floor("recovery_months"), F.lit(1))
    e = explained.select("portfolio_id", "scenario_key", imp.alias("imp"), rec.cast("int").alias("rec"))
    m = e.withColumn("month", F.explode(F.sequence(F.lit(0), F.least(F.col("rec") + 6, F.lit(36)) - 1)))
    tau = F.greatest(F.col("rec") / 3, F.lit(0.5))
    return m.select("portfolio_id", "scenario_key", "imp", "rec", "month",
                    (100 + F.col("imp") * F.exp(-F.col("month") / tau)).alias("level"))


def recovery_milestones(curve: DataFrame) -> DataFrame:
    """First month with a quarter and half of the loss regained (the whole time when never reached)."""
    reached = lambda left: F.min(F.when(F.round("level", 9) >= F.round(100 + F.col("imp") * left, 9), F.col("month")))
    g = curve.groupBy("portfolio_id", "scenario_key", "rec").agg(reached(0.75).alias("m25"), reached(0.5).alias("m50"))
    return g.select("portfolio_id", "scenario_key", F.coalesce("m25", "rec").alias("months_25"),
                    F.coalesce("m50", "rec").alias("months_50"), F.col("rec").alias("months_100"))


def top3_sectors(comp: DataFrame) -> DataFrame:
    """The three largest sectors as text; the list per portfolio holds its sectors, a short list."""
    g = comp.groupBy("portfolio_id").agg(F.collect_list(F.struct(
        (-F.round("weight_pct", 9)).alias("neg"), "sector", "weight_pct")).alias("l"))
    text = F.transform(F.slice(F.array_sort("l"), 1, 3), lambda s: F.concat(
        s["sector"], F.lit(" ("), R.amount(s["weight_pct"], 1), F.lit("%)")))
    return g.select("portfolio_id", F.concat_ws(", ", text).alias("top_sectors"))
