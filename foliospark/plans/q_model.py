"""Queries: features, model, attributions, credit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import cut_lineage
from ..operators import credit as K
from ..operators import features as X
from ..operators import model as M
from ..operators import portfolio as P
from . import views as V
from .registry import query
from .sql_views import VIEWS

COLS = X.RAW_NUMERIC


def digits(c: str) -> int:
    """Digits to compare a column at; market caps are too large for more."""
    return 0 if c == "marketCap" else 9


_SPLIT_SQL = "CASE WHEN symbol % 20 < 14 THEN 'train' WHEN symbol % 20 < 17 THEN 'val' ELSE 'test' END"
_PRED_SQL = "0.4::DOUBLE * coalesce(environment_score, 50) + 0.3::DOUBLE * coalesce(social_score, 50) + 0.3::DOUBLE * coalesce(governance_score, 50)"


def with_prediction(spark, d):
    """Labelled rows with a fixed split and a linear prediction (so that reports can be checked exactly)."""
    f = V.features(spark, d).filter("total_esg IS NOT NULL")
    return f.withColumns({"split": F.expr(_SPLIT_SQL), "prediction": F.expr(_PRED_SQL.replace("::DOUBLE", "D"))})


VIEWS["sql_means"] = "SELECT sector, avg(total_esg) AS m FROM features WHERE NOT imputed AND total_esg IS NOT NULL AND sector <> 'Power' GROUP BY 1"
VIEWS["sql_pred"] = f"""
  SELECT f.*, {_SPLIT_SQL} AS split, {_PRED_SQL} AS prediction,
         coalesce(m.m, (SELECT avg(total_esg) FROM features WHERE NOT imputed AND total_esg IS NOT NULL AND sector <> 'Power')) AS y_proxy
  FROM features f LEFT JOIN sql_means m USING (sector) WHERE total_esg IS NOT NULL"""


def with_baseline(spark, d):
    x = with_prediction(spark, d)
    # all Power rows count as imputed, so that this sector takes the overall mean
    b = X.sector_mean_baseline(x.withColumn("imputed", F.col("imputed") | (F.col("sector") == "Power")))
    return b


@query("j1_detect_features", """
  SELECT * FROM (VALUES ('beta', 'numeric'), ('marketCap', 'numeric'), ('p_name', 'categorical'), ('part_code', 'numeric'), ('sector', 'categorical'), ('title', 'categorical')) AS t(column_name, kind)""")
def _(spark, d):
    # part_code is number text with many values; title is other text with many values
    p = V.table(spark, d, "part").withColumnRenamed("p_partkey", "symbol").selectExpr(
        "symbol", "p_name", "cast(symbol as string) AS part_code", "concat('part ', symbol) AS title")
    f = V.features(spark, d).select("symbol", "sector", "marketCap", "beta", "total_esg", "imputed").join(p, "symbol")
    numeric, categorical = X.detect_features(f, "total_esg")
    return spark.createDataFrame([(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical], "column_name string, kind string")


_RAW = "CASE symbol % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(symbol AS VARCHAR) || '.5' WHEN 2 THEN '1e19' WHEN 3 THEN '-1e300' WHEN 4 THEN NULL ELSE '12' END"


@query("j2_sanitize_numeric", f"""
  SELECT symbol, CASE WHEN abs(TRY_CAST(raw AS DOUBLE)) <= 1e18 THEN TRY_CAST(raw AS DOUBLE) END AS raw FROM (SELECT symbol, {_RAW} AS raw FROM features)""")
def _(spark, d):
    return X.sanitize_numeric(V.features(spark, d).select("symbol", F.expr(_RAW.replace("VARCHAR", "STRING")).alias("raw")), ["raw"])


@query("j3_market_cap_log", "SELECT symbol, round(CASE WHEN marketCap > 0 THEN ln(1 + marketCap) END, 9) AS marketCap_log FROM features")
def _(spark, d):
    return X.market_cap_log(V.features(spark, d)).select("symbol", F.round("marketCap_log", 9).alias("marketCap_log"))


_FILL = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in COLS)
_MED = ", ".join(f"median({c}) AS m_{c}" for c in COLS)


@query("j4_impute_median_scale", f"""
  WITH m AS (SELECT {_MED} FROM features WHERE NOT imputed), f AS (SELECT symbol, imputed, {_FILL} FROM features, m),
  s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in COLS)} FROM f WHERE NOT imputed)
  SELECT symbol, {", ".join(f"round(({c} - a_{c}) / s_{c}, 8) AS {c}" for c in COLS)} FROM f, s""")
def _(spark, d):
    f = V.features(spark, d)
    x = X.ImputeScale().fit(f.filter("NOT imputed"), COLS).transform(f)
    return x.select("symbol", *[F.round(c, 8).alias(c) for c in COLS])


_CATS = sorted([s for s in V.SECTORS if s != "Power"] + [X.UNKNOWN])
_SECT = "CASE WHEN symbol % 13 = 0 THEN NULL ELSE sector END"


@query("j5_encode_categories", f"""
  SELECT symbol, {", ".join(f'CAST(coalesce({_SECT}, {chr(39)}{X.UNKNOWN}{chr(39)}) = {chr(39)}{c}{chr(39)} AS INT) AS "sector_{c}"' for c in _CATS)} FROM features""")
def _(spark, d):
    # Power does not occur in the training rows
    f = V.features(spark, d).select("symbol", F.expr(_SECT).alias("sector"))
    enc = X.EncodeCategories().fit(f.filter("sector IS NULL OR sector <> 'Power'"), "sector")
    return enc.transform(f).drop("sector")


@query("j17_align_dummies", f"""
  SELECT {", ".join(f'CAST(coalesce({_SECT}, {chr(39)}{X.UNKNOWN}{chr(39)}) = {chr(39)}{c}{chr(39)} AS INT) AS "sector_{c}"' for c in _CATS[:4])}, beta, 0 AS sector_New, symbol FROM features""")
def _(spark, d):
    f = V.features(spark, d).select("symbol", "beta", "ret_1m", F.expr(_SECT).alias("sector"))
    enc = X.EncodeCategories().fit(f.filter("sector IS NULL OR sector <> 'Power'"), "sector")
    return X.align_dummies(f, [enc], [f"sector_{c}" for c in _CATS[:4]] + ["beta", "sector_New", "symbol"])


# categories numbered in their order: those of the training rows (all but Power), blanks as one of them
_INDEX = f"""WITH c AS (SELECT symbol, beta, coalesce({_SECT}, '{X.UNKNOWN}') AS v FROM features),
  i AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT v FROM c WHERE v <> 'Power'))"""


@query("j5_sparse_categories", f"""{_INDEX}
  SELECT symbol, CAST((SELECT max(n) FROM i) AS INT) AS size, CAST(coalesce(i, -1) AS INT) AS position FROM c LEFT JOIN i USING (v)""")
def _(spark, d):
    f = V.features(spark, d).select("symbol", F.expr(_SECT).alias("sector"))
    enc = X.CategoryIndex().fit(f.filter("sector IS NULL OR sector <> 'Power'"), "sector")
    return enc.transform(f, "x", ["symbol"]).select("symbol", "x.size", F.coalesce(F.get("x.indices", F.lit(0)), F.lit(-1)).alias("position"))


@query("j17_sparse_align", f"""{_INDEX}
  SELECT symbol, CAST((SELECT max(n) FROM i) + 2 AS INT) AS size, concat_ws(',', CASE WHEN coalesce(beta, 0) <> 0 THEN '0' END, CAST(i + 2 AS VARCHAR)) AS places,
    CASE WHEN coalesce(beta, 0) <> 0 THEN beta ELSE 0 END + CASE WHEN i IS NULL THEN 0 ELSE 1 END AS total FROM c LEFT JOIN i USING (v)""")
def _(spark, d):
    # the training layout has a number that the new rows lack
    f = V.features(spark, d).select("symbol", "beta", F.expr(_SECT).alias("sector"))
    enc = X.CategoryIndex().fit(f.filter("sector IS NULL OR sector <> 'Power'"), "sector")
    x = X.align_sparse(f, [enc], ["beta", "gone"], "x", ["symbol"])
    return x.select("symbol", "x.size", F.array_join(F.col("x.indices").cast("array<string>"), ",").alias("places"),
                    F.aggregate("x.values", F.lit(0.0), lambda a, v: a + v).alias("total"))


VIEWS["sql_split"] = """SELECT *, CASE WHEN b < 7000 THEN 'train' WHEN b < 8500 THEN 'val' ELSE 'test' END AS split, digest FROM (
  SELECT *, md5(CAST(symbol AS VARCHAR) || ':42') AS digest, CAST('0x' || substr(md5(CAST(symbol AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 10000 AS b FROM features)"""


@query("j6_split_rows", "SELECT split, count(*) AS rows FROM sql_split GROUP BY 1")
def _(spark, d):
    return X.split_rows(V.features(spark, d), "symbol").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("j7_sample_weight", """
  SELECT symbol, CASE WHEN imputed THEN 0.5::DOUBLE ELSE 1.0 END AS weight FROM features WHERE total_esg IS NOT NULL""")
def _(spark, d):
    return X.sample_weight(V.features(spark, d)).select("symbol", "weight")


@query("e34_sector_medians", f"""
  SELECT sector, {", ".join(f"round(median({c}), {digits(c)}) AS {c}" for c in COLS)} FROM features GROUP BY 1
  UNION ALL SELECT 'Other', {", ".join(f"round(median({c}), {digits(c)})" for c in COLS)} FROM features""")
def _(spark, d):
    return X.sector_medians(V.features(spark, d)).select("sector", *[F.round(c, digits(c)).alias(c) for c in COLS])


@query("e35_sector_mean_baseline", "SELECT symbol, round(y_proxy, 6) AS y_proxy FROM sql_pred")
def _(spark, d):
    return with_baseline(spark, d).select("symbol", F.round("y_proxy", 6).alias("y_proxy"))


@query("e36_label_stats", """
  SELECT split, count(total_esg) AS n, round(avg(total_esg), 6) AS mean, round(stddev_pop(total_esg), 6) AS std, min(total_esg) AS min, max(total_esg) AS max FROM sql_pred GROUP BY 1""")
def _(spark, d):
    return X.label_stats(with_prediction(spark, d))


def _metrics(p):
    return f"count(*) AS n, avg(abs(total_esg - {p})) AS mae, sqrt(avg((total_esg - {p}) * (total_esg - {p}))) AS rmse, 1 - avg((total_esg - {p}) * (total_esg - {p})) / var_pop(total_esg) AS r2"


@query("e37_regression_metrics", f"""
  SELECT split, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM (SELECT split, {_metrics('prediction')} FROM sql_pred GROUP BY 1)""")
def _(spark, d):
    return X.regression_metrics(with_prediction(spark, d), "total_esg", "prediction")


@query("e38_model_vs_baseline", f"""
  WITH m AS (SELECT split, {_metrics('prediction')} FROM sql_pred GROUP BY 1), b AS (SELECT split, {_metrics('y_proxy')} FROM sql_pred GROUP BY 1)
  SELECT split, round(m.mae, 6) AS model_mae, round(m.rmse, 6) AS model_rmse, round(b.mae, 6) AS baseline_mae, round(b.rmse, 6) AS baseline_rmse,
         round(round(b.mae, 6) - round(m.mae, 6), 6) AS mae_gain, round(round(b.rmse, 6) - round(m.rmse, 6), 6) AS rmse_gain FROM m JOIN b USING (split)""")
def _(spark, d):
    return X.model_vs_baseline(with_baseline(spark, d), "total_esg", "prediction", "y_proxy")


@query("e39_prediction_diagnostics", """
  SELECT count(*) AS n, round(avg(prediction), 6) AS pred_mean, round(stddev_pop(prediction), 6) AS pred_std, count(DISTINCT round(prediction, 6)) AS unique_predictions,
         count(*) FILTER (abs(prediction - 50) <= 0.0015) AS near_50, round(avg(CASE WHEN abs(prediction - 50) <= 0.0015 THEN 1.0::DOUBLE ELSE 0 END), 6) AS near_50_share,
         round(corr(prediction, y_proxy), 6) AS corr_with_baseline FROM sql_pred""")
def _(spark, d):
    return X.prediction_diagnostics(with_baseline(spark, d), "prediction", "y_proxy")


_VAR_COLS = [c for c in COLS if c != "marketCap"]


@query("e40_feature_variance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 9) AS variance, var_pop({c}) = 0 AS zero_variance, var_pop({c}) < 1e-6 AS low_variance FROM features"
    for c in _VAR_COLS))
def _(spark, d):
    return X.feature_variance(V.features(spark, d), _VAR_COLS)


def _sides(spark, d):
    f = V.features(spark, d)
    k = F.col("symbol")
    base = f.select("symbol", F.when(F.col("sector") == "Media & Entertainment", F.lit("Unlisted")).otherwise(F.col("sector")).alias("sector"))
    gap = [F.when(k % 5 != 0, F.col(c)).alias(c) if c in X.PILLARS + ["beta"] else F.col(c) for c in COLS]
    cached = f.filter("trailingPE < 20").select("symbol", *gap)
    provider = f.filter("beta >= 1.2").select("symbol", *[F.lit(None).cast("double").alias(c) if c in X.PILLARS else F.col(c) for c in COLS])
    return base, cached, provider, X.sector_medians(f.filter("sector <> 'Media & Entertainment'"))


VIEWS["sql_filled"] = f"""
  WITH b AS (SELECT symbol, CASE WHEN sector = 'Media & Entertainment' THEN 'Unlisted' ELSE sector END AS sector FROM features),
  c AS (SELECT symbol, {", ".join(f"CASE WHEN symbol % 5 <> 0 THEN {c} END AS {c}" if c in X.PILLARS + ["beta"] else c for c in COLS)} FROM features WHERE trailingPE < 20 AND marketCap IS NOT NULL),
  p AS (SELECT symbol, {", ".join(f"NULL::DOUBLE AS {c}" if c in X.PILLARS else c for c in COLS)} FROM features WHERE beta >= 1.2 AND marketCap IS NOT NULL),
  m AS (SELECT sector, {", ".join(f"median({c}) AS {c}" for c in COLS)} FROM features WHERE sector <> 'Media & Entertainment' GROUP BY 1),
  o AS (SELECT {", ".join(f"median({c}) AS {c}" for c in COLS)} FROM features WHERE sector <> 'Media & Entertainment'),
  r AS (SELECT b.symbol, b.sector, c.symbol IS NOT NULL AS hc, p.symbol IS NOT NULL AS hp,
          {", ".join(f"CASE WHEN c.symbol IS NOT NULL THEN c.{c} WHEN p.symbol IS NOT NULL THEN p.{c} END AS r_{c}" for c in COLS)},
          {", ".join(f"CASE WHEN m.sector IS NOT NULL THEN m.{c} ELSE o.{c} END AS d_{c}" for c in COLS)}
        FROM b LEFT JOIN c USING (symbol) LEFT JOIN p USING (symbol) LEFT JOIN m ON m.sector = b.sector, o)
  SELECT symbol, sector, {", ".join(f"coalesce(r_{c}, d_{c}) AS {c}" for c in COLS)},
     list_filter([{", ".join(f"CASE WHEN r_{c} IS NULL THEN '{c}' END" for c in COLS)}], lambda x: x IS NOT NULL) AS imp,
     CASE WHEN hc THEN 'cache' WHEN hp THEN 'yahoo' ELSE 'sector_defaults_complete' END
       || CASE WHEN (hc OR hp) AND {" AND ".join(f"r_{c} IS NULL" for c in X.PILLARS)} THEN ',sector_defaults_esg' ELSE '' END AS sources FROM r"""


@query("j10_fill_features", f"""
  SELECT symbol, sector, {", ".join(f"round({c}, {digits(c)}) AS {c}" for c in COLS)}, array_to_string(imp, ',') AS imputed_columns, sources FROM sql_filled""")
def _(spark, d):
    x = X.fill_features(*_sides(spark, d))
    return x.select("symbol", "sector", *[F.round(c, digits(c)).alias(c) for c in COLS], F.array_join("imputed_columns", ",").alias("imputed_columns"), "sources")


@query("j11_imputation_guard", f"""
  SELECT symbol, round(len(imp) / 10, 6) AS imputation_ratio, round(len(imp) / 10, 6) <= 0.45 AS predictable,
     {" AND ".join(f"list_contains(imp, '{c}')" for c in X.PILLARS)} AS all_pillars_imputed,
     coalesce(list_var_pop([{", ".join(COLS)}]) < 1e-6, false) AS low_variance,
     CASE WHEN round(len(imp) / 10, 6) > 0.45 THEN 'model_failed_too_many_imputed' ELSE 'predicted_by_model' END AS reason FROM sql_filled""")
def _(spark, d):
    g = X.imputation_guard(X.fill_features(*_sides(spark, d)))
    return g.select("symbol", "imputation_ratio", "predictable", "all_pillars_imputed", "low_variance", "reason")


# the model: trained on the given tables, so its numbers have no SQL form
def training_rows(spark, d):
    f = X.market_cap_log(X.sample_weight(V.features(spark, d)))
    return X.split_rows(f, "symbol")


MODEL_COLS = COLS + ["marketCap_log"]


def fitted(spark, d):
    """Prepared rows and the stored model; the first query of these inputs trains it."""
    t = training_rows(spark, d)
    model = M.stored_model(t, MODEL_COLS, "sector")
    return model.prepare(t), model


def judged(spark, d):
    x, model = fitted(spark, d)
    return X.model_vs_baseline(X.sector_mean_baseline(M.predict_esg(x, model.trees, model.cols)), "total_esg", "prediction", "y_proxy")


VIEWS["sql_labelled"] = "SELECT * FROM sql_split WHERE total_esg IS NOT NULL"
VIEWS["sql_proxy"] = """
  SELECT l.*, coalesce(m.m, (SELECT avg(total_esg) FROM sql_labelled WHERE NOT imputed)) AS y_proxy FROM sql_labelled l
  LEFT JOIN (SELECT sector, avg(total_esg) AS m FROM sql_labelled WHERE NOT imputed GROUP BY 1) m USING (sector)"""


@query("j8_train_esg")
def _(spark, d):
    return judged(spark, d)


@query("j8_train_facts", """
  SELECT split, round(avg(abs(total_esg - y_proxy)), 6) AS baseline_mae, round(sqrt(avg((total_esg - y_proxy) * (total_esg - y_proxy))), 6) AS baseline_rmse, true AS better
  FROM sql_proxy GROUP BY 1""")
def _(spark, d):
    return judged(spark, d).select("split", "baseline_mae", "baseline_rmse", ((F.col("mae_gain") > 0) & (F.col("rmse_gain") > 0)).alias("better"))


@query("j9_predict_esg")
def _(spark, d):
    x, model = fitted(spark, d)
    return M.predict_esg(x, model.trees, model.cols).select("symbol", "split", F.round("prediction", 6).alias("prediction"))


@query("j9_predict_facts", "SELECT symbol, split, true AS within, true AS near FROM sql_labelled")
def _(spark, d):
    # every score lies within 0..100, and within 30 points of its label (labels span over 50)
    x, model = fitted(spark, d)
    p = F.col("prediction")
    return M.predict_esg(x, model.trees, model.cols).select("symbol", "split", p.between(0, 100).alias("within"), (F.abs(p - F.col("total_esg")) < 30).alias("near"))


@query("j12_feature_importance")
def _(spark, d):
    return M.feature_importance(spark, fitted(spark, d)[1].trees)


@query("j12_importance_facts", f"""
  SELECT CAST({len(MODEL_COLS)} + count(DISTINCT coalesce(sector, '{X.UNKNOWN}')) AS BIGINT) AS features, 1.0::DOUBLE AS total, true AS pillar_first FROM sql_labelled WHERE split = 'train'""")
def _(spark, d):
    found = M.feature_importance(spark, fitted(spark, d)[1].trees)
    return found.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                     F.min_by(F.col("feature").isin(*X.PILLARS), "rank").alias("pillar_first"))


def explained(spark, d, split="val"):
    x, model = fitted(spark, d)
    rows = x.filter(F.col("split") == split) if split else x
    return model, rows, model.trees.explain(rows, "symbol")


@query("j15_shapley_sampled")
def _(spark, d):
    # the trees are at hand, so their attributions are exact instead of sampled
    return explained(spark, d)[2].select("symbol", "feature", "attribution")


@query("j15_attribution_facts", f"""
  SELECT symbol, CAST({len(MODEL_COLS)} + (SELECT count(DISTINCT coalesce(sector, '{X.UNKNOWN}')) FROM sql_labelled WHERE split = 'train') AS BIGINT) AS features, true AS adds_up
  FROM sql_labelled WHERE split = 'val'""")
def _(spark, d):
    model, rows, parts = explained(spark, d)
    sums = parts.groupBy("symbol").agg(F.count(F.lit(1)).alias("features"), F.sum("attribution").alias("s"))
    return model.trees.score(rows).join(sums, "symbol").select(
        "symbol", "features", (F.abs(F.col("s") + F.lit(model.trees.expected()) - F.col("prediction")) < 1e-9).alias("adds_up"))


@query("j16_local_surrogate")
def _(spark, d):
    x, model = fitted(spark, d)
    return M.local_surrogate(x.filter("split = 'val'"), "symbol", model.trees, model.cols)


@query("j24_shap_sample", f"""
  SELECT symbol, {", ".join(COLS)}, round(CASE WHEN marketCap > 0 THEN ln(1 + marketCap) END, 9) AS marketCap_log FROM sql_split
  WHERE total_esg IS NOT NULL AND split = 'val' ORDER BY digest, symbol LIMIT 50""")
def _(spark, d):
    t = training_rows(spark, d)
    return M.shap_sample(t.filter("split = 'val'"), "symbol", 50).select("symbol", *COLS, F.round("marketCap_log", 9).alias("marketCap_log"))


# linear attributions
COEF = {"environment_score": 0.4, "social_score": 0.3, "governance_score": 0.3, "beta": -1.5, "trailingPE": 0.05}
_MEANS = ", ".join(f"avg({c}) AS mean_{c}" for c in COEF)
VIEWS["sql_attr"] = "WITH f AS (SELECT * FROM features WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COEF) + f"), m AS (SELECT {_MEANS} FROM f) " + " UNION ALL ".join(
    f"SELECT symbol AS security_id, '{c}' AS feature, {c} AS value, {b}::DOUBLE * ({c} - mean_{c}) AS attribution FROM f, m" for c, b in COEF.items())


def attributions(spark, d):
    f = V.features(spark, d).dropna(subset=list(COEF)).withColumnRenamed("symbol", "security_id")
    return M.shapley_linear(f, "security_id", COEF, M.column_means(f, list(COEF)))


@query("j14_shapley_linear", "SELECT security_id, feature, value, round(attribution, 6) AS attribution FROM sql_attr")
def _(spark, d):
    return attributions(spark, d).withColumn("attribution", F.round("attribution", 6))


@query("e41_global_importance", "SELECT feature, round(avg(abs(attribution)), 6) AS mean_abs FROM sql_attr GROUP BY 1")
def _(spark, d):
    return M.global_importance(attributions(spark, d))


@query("g5_top_features", """
  SELECT * FROM (SELECT security_id, feature, round(attribution, 6) AS attribution,
    CAST(row_number() OVER (PARTITION BY security_id ORDER BY round(abs(attribution), 9) DESC, feature) AS INT) AS rank FROM sql_attr) WHERE rank <= 3""")
def _(spark, d):
    return M.top_features(attributions(spark, d), "security_id", 3).select("security_id", "feature", F.round("attribution", 6).alias("attribution"), "rank")


@query("j23_attribution_record", """
  SELECT security_id, 52.5::DOUBLE AS base, feature, value, round(attribution, 6) AS shap, round(abs(attribution), 6) AS abs_shap FROM sql_attr""")
def _(spark, d):
    record = "base double, features array<struct<feature: string, value: double, shap: double, abs_shap: double>>"
    r = M.attribution_record(attributions(spark, d), "security_id", 52.5).select("security_id", F.from_json("record", record).alias("r"))
    return r.select("security_id", "r.base", F.explode("r.features").alias("f")).select(
        "security_id", "base", "f.feature", "f.value", F.round("f.shap", 6).alias("shap"), F.round("f.abs_shap", 6).alias("abs_shap"))


VIEWS["sql_pattr"] = """
  WITH p AS (SELECT portfolio_id, security_id, sum(w) AS w FROM (SELECT portfolio_id, security_id, value / sum(value) OVER (PARTITION BY portfolio_id) AS w FROM holdings) GROUP BY 1, 2),
  c AS (SELECT portfolio_id, sum(w) AS coverage FROM p WHERE security_id IN (SELECT security_id FROM sql_attr) GROUP BY 1),
  g AS (SELECT portfolio_id, feature, sum(w * attribution) AS contribution FROM p JOIN sql_attr USING (security_id) GROUP BY 1, 2)
  SELECT g.*, coverage, sum(contribution) OVER (PARTITION BY portfolio_id) AS total FROM g JOIN c USING (portfolio_id)"""


@query("e42_portfolio_attribution", """
  SELECT portfolio_id, feature, round(contribution, 6) AS contribution,
         CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY round(abs(contribution), 9) DESC, feature) AS INT) AS rank,
         round(coverage * 52.5::DOUBLE, 6) AS base, round(coverage * 52.5::DOUBLE + total, 6) AS prediction, round(coverage, 6) AS coverage_weight FROM sql_pattr""")
def _(spark, d):
    return M.portfolio_attribution(P.weights(V.holdings(spark, d)), attributions(spark, d), 52.5).filter("rank <= 20")  # a report of the largest


@query("e43_attribution_groups", """
  WITH x AS (SELECT portfolio_id, round(contribution, 6) AS contribution, CASE WHEN regexp_matches(lower(feature), 'environment|social|governance|esg') THEN 'ESG Components' WHEN lower(feature) = 'trailingpe' THEN 'Financial Metrics' ELSE 'Market Behavior' END AS g FROM sql_pattr),
  p AS (SELECT DISTINCT portfolio_id FROM x)
  SELECT p.portfolio_id, n.g AS feature_group, round(coalesce(sum(x.contribution), 0), 6) AS contribution
  FROM p JOIN (VALUES ('ESG Components'), ('Sector'), ('Market Cap'), ('Financial Metrics'), ('Market Behavior'), ('Other')) n(g) ON true
  LEFT JOIN x ON x.portfolio_id = p.portfolio_id AND x.g = n.g GROUP BY 1, 2""")
def _(spark, d):
    return M.attribution_groups(M.portfolio_attribution(P.weights(V.holdings(spark, d)), attributions(spark, d), 52.5))


# credit
VIEWS["sql_credit"] = """
  WITH s AS (SELECT *, greatest(0, least(100, 50
     + CASE WHEN income > 100000 THEN -15 WHEN income > 50000 THEN -5 ELSE 10 END + CASE WHEN employment_years >= 5 THEN -10 WHEN employment_years >= 2 THEN -5 ELSE 15 END
     + CASE WHEN debt_to_income < 0.30 THEN -10 WHEN debt_to_income > 0.50 THEN 20 ELSE 0 END + CASE WHEN credit_utilization < 0.30 THEN -10 WHEN credit_utilization > 0.70 THEN 15 ELSE 0 END
     + late_payments_last_2y * 10 + CASE WHEN credit_history_months >= 60 THEN -10 WHEN credit_history_months < 24 THEN 15 ELSE 0 END)) AS risk_score FROM applicants)
  SELECT *, CASE WHEN risk_score < 30 THEN 'APPROVED' WHEN risk_score < 50 THEN 'CONDITIONAL APPROVAL' ELSE 'DECLINED' END AS decision FROM s"""


def decided(spark, d):
    return K.credit_decision(K.credit_score(V.applicants(spark, d)))


@query("j18_credit_score", "SELECT applicant_id, risk_score FROM sql_credit")
def _(spark, d):
    return K.credit_score(V.applicants(spark, d)).select("applicant_id", "risk_score")


@query("j19_credit_decision", "SELECT applicant_id, risk_score, decision FROM sql_credit")
def _(spark, d):
    return decided(spark, d).select("applicant_id", "risk_score", "decision")


def _p(c, n):
    return f"CAST(CAST(round(CAST({c} * 100 AS DECIMAL(38,9)), {n}) AS DECIMAL(38,{n})) AS VARCHAR)"


VIEWS["sql_reasons"] = f"""
  SELECT applicant_id, unnest(list_filter([
    CASE WHEN debt_to_income > 0.40 THEN {{'f': 'High Debt-to-Income Ratio', 'e': 'negative', 'd': {_p('debt_to_income', 1)} || '% exceeds 40% threshold'}} END,
    CASE WHEN credit_utilization > 0.50 THEN {{'f': 'High Credit Utilization', 'e': 'negative', 'd': {_p('credit_utilization', 1)} || '% utilization'}} END,
    CASE WHEN late_payments_last_2y > 0 THEN {{'f': 'Recent Late Payments', 'e': 'negative', 'd': late_payments_last_2y || ' late payment(s) in last 2 years'}} END,
    CASE WHEN income > 60000 THEN {{'f': 'Strong Income', 'e': 'positive', 'd': '₹' || CAST(CAST(round(income, 2) AS DECIMAL(38,2)) AS VARCHAR) || ' annual income'}} END,
    CASE WHEN employment_years >= 3 THEN {{'f': 'Stable Employment', 'e': 'positive', 'd': employment_years || ' years with employer'}} END,
    CASE WHEN credit_history_months >= 48 THEN {{'f': 'Established Credit History', 'e': 'positive', 'd': credit_history_months || ' months of history'}} END],
    lambda x: x IS NOT NULL)) AS r FROM applicants"""


@query("j20_reason_codes", "SELECT applicant_id, r.f AS factor, r.e AS effect, r.d AS detail FROM sql_reasons")
def _(spark, d):
    return K.reason_codes(V.applicants(spark, d)).drop("ord")


@query("j21_counterfactuals", f"""
  WITH x AS (SELECT applicant_id, list_filter([
     CASE WHEN debt_to_income > 0.40 THEN 'Reduce debt-to-income ratio to <35%: pay down ' || CAST(floor(existing_debt * 0.2::DOUBLE) AS BIGINT) || ' of existing debt or increase income to ' || CAST(floor(existing_debt / 0.35::DOUBLE) AS BIGINT) || '/year' END,
     CASE WHEN credit_utilization > 0.50 THEN 'Lower credit utilization to <30%: current ' || {_p('credit_utilization', 0)} || '%, target 30%' END,
     CASE WHEN late_payments_last_2y > 0 THEN 'Maintain on-time payments for next 12 months' END], lambda r: r IS NOT NULL) AS l FROM sql_credit WHERE decision <> 'APPROVED')
  SELECT applicant_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['Consider a smaller loan amount', 'Add a co-applicant with strong credit'] END) AS recommendation FROM x""")
def _(spark, d):
    return K.counterfactuals(decided(spark, d)).drop("ord")


@query("j22_adverse_notice", """
  SELECT applicant_id, decision, concat_ws(chr(10), 'NOTICE OF ADVERSE ACTION', 'We regret to inform you that your application for credit has been declined or conditionally approved.',
    'Principal reason(s) for this decision:', array_to_string(list_transform(l, lambda r, i: i || '. ' || r), chr(10)),
    'You have the right to request a free copy of your credit report, dispute inaccurate information, and reapply after addressing the above factors.') AS notice
  FROM (SELECT applicant_id, decision, list_filter([CASE WHEN debt_to_income > 0.40 THEN 'High Debt-to-Income Ratio' END, CASE WHEN credit_utilization > 0.50 THEN 'High Credit Utilization' END,
     CASE WHEN late_payments_last_2y > 0 THEN 'Recent Late Payments' END], lambda r: r IS NOT NULL) AS l FROM sql_credit WHERE decision <> 'APPROVED')""")
def _(spark, d):
    return K.adverse_notice(decided(spark, d))


@query("j22_model_adverse_notice", """
  WITH t AS (SELECT security_id, feature, attribution, row_number() OVER (PARTITION BY security_id ORDER BY round(abs(attribution), 9) DESC, feature) AS rank FROM sql_attr)
  SELECT security_id, 'Adverse Action Notice (Compliant with ECOA/GDPR):' || chr(10) || 'Reason: Top factors - '
     || string_agg(feature || ' (impact: ' || CAST(CAST(round(attribution, 3) AS DECIMAL(38,3)) AS VARCHAR) || ')', ', ' ORDER BY rank)
     || chr(10) || 'You have the right to request more details within 60 days.' AS notice
  FROM t WHERE rank <= 3 AND security_id IN (SELECT symbol FROM features WHERE total_esg < 55) GROUP BY 1""")
def _(spark, d):
    top = M.top_features(attributions(spark, d), "security_id", 3)
    rejected = V.features(spark, d).filter("total_esg < 55").select(F.col("symbol").alias("security_id"))
    return K.model_adverse_notice(rejected, top, "security_id")


# attributions of the stored model, with its own base
def model_attributions(spark, d):
    model, _, parts = explained(spark, d, None)
    return model, cut_lineage(parts.withColumnRenamed("symbol", "security_id"))


def model_attribution_rows(spark, d):
    """The same, one array for each security."""
    x, model = fitted(spark, d)
    return model, model.trees.explain_rows(x, "symbol").withColumnRenamed("symbol", "security_id")


def stored_weights(spark, d):
    """Weights of positions; the holdings are read for the totals and for the shares, and their ids only spread them over tasks."""
    return P.weights(cut_lineage(V.holdings(spark, d).select("portfolio_id", "security_id", "value", F.xxhash64("holding_id").alias("holding_id"))))


VIEWS["sql_model_cover"] = """
  SELECT portfolio_id, round(sum(CASE WHEN security_id IN (SELECT symbol FROM sql_labelled) THEN w ELSE 0 END), 6) AS coverage_weight
  FROM (SELECT portfolio_id, security_id, value / sum(value) OVER (PARTITION BY portfolio_id) AS w FROM holdings) GROUP BY 1
  HAVING bool_or(security_id IN (SELECT symbol FROM sql_labelled))"""


@query("e42_model_attribution", "SELECT portfolio_id, coverage_weight, true AS adds_up FROM sql_model_cover")
def _(spark, d):
    """Base and contributions of every portfolio against the weighted scores of its securities."""
    model, parts = model_attribution_rows(spark, d)
    w, base = cut_lineage(stored_weights(spark, d).select("portfolio_id", "security_id", "weight")), model.trees.expected()  # read twice
    whole = M.portfolio_attribution(w, parts, base, model.cols).groupBy("portfolio_id").agg(
        F.first("coverage_weight").alias("coverage_weight"), F.first("base").alias("base"), F.first("prediction").alias("prediction"), F.sum("contribution").alias("sum"))
    scores = model.trees.score(model.prepare(training_rows(spark, d))).select(F.col("symbol").alias("security_id"), F.col("prediction").alias("score"))
    scored = w.join(scores, "security_id").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("score")).alias("weighted"))
    near = lambda a, b: F.abs(F.col(a) - b) < 1e-4
    return whole.join(scored, "portfolio_id").select("portfolio_id", "coverage_weight", (near("prediction", F.col("weighted")) & near("prediction", F.col("base") + F.col("sum"))).alias("adds_up"))


@query("e43_model_groups", """
  SELECT portfolio_id, g AS feature_group, g IN ('Other') AS empty FROM sql_model_cover
  JOIN (VALUES ('ESG Components'), ('Sector'), ('Market Cap'), ('Financial Metrics'), ('Market Behavior'), ('Other')) n(g) ON true""")
def _(spark, d):
    model, parts = model_attribution_rows(spark, d)
    found = M.attribution_groups(M.portfolio_attribution(stored_weights(spark, d), parts, model.trees.expected(), model.cols))
    return found.select("portfolio_id", "feature_group", ((F.col("feature_group") == "Other") & (F.col("contribution") == 0)).alias("empty"))


@query("g5_model_features", "SELECT symbol AS security_id, 3::BIGINT AS features, true AS falling FROM sql_labelled")
def _(spark, d):
    top = M.top_features(model_attributions(spark, d)[1], "security_id", 3)
    size = F.round(F.abs("attribution"), 9)
    at = lambda k: F.max(F.when(F.col("rank") == k, size))
    return top.groupBy("security_id").agg(F.count(F.lit(1)).alias("features"), ((at(1) >= at(2)) & (at(2) >= at(3))).alias("falling"))


@query("j23_model_record", "SELECT symbol AS security_id, true AS adds_up FROM sql_labelled")
def _(spark, d):
    model, parts = model_attributions(spark, d)
    kind = "base double, features array<struct<feature: string, value: double, shap: double, abs_shap: double>>"
    r = M.attribution_record(parts, "security_id", model.trees.expected()).select("security_id", F.from_json("record", kind).alias("r"))
    scores = model.trees.score(model.prepare(training_rows(spark, d))).select(F.col("symbol").alias("security_id"), "prediction")
    total = F.aggregate("r.features", F.col("r.base"), lambda s, f: s + f["shap"])
    return r.join(scores, "security_id").select("security_id", (F.abs(total - F.col("prediction")) < 1e-6).alias("adds_up"))
