"""Queries: provider rows, snapshots, price series, value at risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ratings as R
from ..operators import market as M
from . import views as V
from .registry import query
from .sql_views import VIEWS

VIEWS["sql_latest"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fetch_ts DESC, provider, fact_id DESC) AS rn FROM sql_snap) WHERE rn = 1"""
_SCORES = ["e", "s", "g", "overall"]
_RS = ", ".join(f"round({c}, 4) AS {c}" for c in _SCORES)


def snapshots(spark, d):
    return M.merge_provider_scores(V.provider_rows(spark, d))


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in _SCORES])


@query("f9_latest_snapshot", f"SELECT ticker, provider, fact_id, {_RS} FROM sql_latest")
def _(spark, d):
    return _rounded(M.latest_snapshot(snapshots(spark, d)), "ticker", "provider", "fact_id")


def _fresh_sql(days):
    return f"""
  SELECT h.security_id, l.provider IS NOT NULL AS fresh, coalesce(provider, '') AS provider, round(overall, 4) AS overall
  FROM securities h LEFT JOIN (SELECT * FROM sql_latest WHERE date_diff('day', CAST(fetch_ts AS DATE), DATE '{V.AS_OF}') <= {days}) l ON l.ticker = h.ticker"""


def _fresh(days):
    def run(spark, d):
        fresh = M.fresh_snapshot(snapshots(spark, d), V.AS_OF, days)
        j = V.securities(spark, d).join(fresh, "ticker", "left")
        return j.select("security_id", F.col("provider").isNotNull().alias("fresh"), F.coalesce("provider", F.lit("")).alias("provider"),
                        F.round("overall", 4).alias("overall"))
    return run


query("d9_fresh_snapshot", _fresh_sql(90))(_fresh(90))
query("d9_fresh_snapshot_model_cache", _fresh_sql(2))(_fresh(2))

ORDER = ["nse", "yahoo", "fmp", "iex"]
VIEWS["sql_market"] = f"""
  WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY
      CASE provider {" ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(ORDER))} ELSE 9 END, fetch_ts DESC, market_cap) AS rn FROM market_facts WHERE ok) WHERE rn = 1),
  s AS (SELECT p_partkey AS symbol, p_name || ' bank power' AS name FROM part),
  k AS (SELECT name, c.ord, c.sector, count(*) AS sc FROM (SELECT DISTINCT name FROM s) JOIN lk_coarse_keyword c ON contains(upper(name), c.keyword) GROUP BY ALL),
  w AS (SELECT name, arg_max(sector, (sc, -ord)) AS by_name FROM k GROUP BY 1)
  SELECT s.symbol, s.name, CASE WHEN b.provider IS NULL THEN coalesce(by_name, 'Diversified') ELSE b.sector END AS sector,
     coalesce(b.market_cap, 0) AS market_cap,
     CASE WHEN b.provider IS NULL THEN 'Unknown Cap' WHEN b.market_cap >= 1e10 THEN 'Large Cap' WHEN b.market_cap >= 2e9 THEN 'Mid Cap' ELSE 'Small Cap' END AS cap_category,
     coalesce(b.provider, 'Fallback Classifier') AS provider, coalesce(b.data_quality, 'Low') AS data_quality
  FROM s LEFT JOIN b USING (symbol) LEFT JOIN w USING (name)"""


def market(spark, d):
    p = V.table(spark, d, "part")
    symbols = p.select(F.col("p_partkey").alias("symbol"), F.concat(F.col("p_name"), F.lit(" bank power")).alias("name"))
    return M.provider_fallback(symbols, V.market_facts(spark, d), ORDER)


@query("d10_provider_fallback", "SELECT symbol, name, sector, round(market_cap, 2) AS market_cap, cap_category, provider, data_quality FROM sql_market")
def _(spark, d):
    return market(spark, d).withColumn("market_cap", F.round("market_cap", 2))


@query("e33_quality_summary", """
  SELECT count(*) AS total_symbols, count(*) FILTER (data_quality = 'High') AS high_quality, count(*) FILTER (data_quality = 'Medium') AS medium_quality,
         count(*) FILTER (data_quality NOT IN ('High', 'Medium')) AS low_quality,
         (SELECT string_agg(provider, ',' ORDER BY provider) FROM (SELECT DISTINCT provider FROM sql_market)) AS providers_used FROM sql_market""")
def _(spark, d):
    return M.quality_summary(market(spark, d))


_TREND = ", ".join(f"arg_max(overall, (fetch_ts, fact_id)) FILTER (CAST(fetch_ts AS DATE) <= DATE '{V.AS_OF}' - {9 * i}) AS s{i}" for i in range(4))


@query("f10_esg_trend", f"""
  SELECT ticker, round(s0, 4) AS score_0, round(s1, 4) AS score_1, round(s2, 4) AS score_2, round(s3, 4) AS score_3, round(s0 - s3, 4) AS change,
         CASE WHEN s0 - s3 IS NULL THEN 'No Data' WHEN round(s0 - s3, 9) > 0 THEN 'Improving' ELSE 'Declining' END AS direction
  FROM (SELECT ticker, {_TREND} FROM sql_snap GROUP BY 1)""")
def _(spark, d):
    return M.esg_trend(snapshots(spark, d), V.AS_OF, 9)


VIEWS["sql_returns"] = """
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM prices_long"""


@query("f1_daily_returns", "SELECT symbol, CAST(dt AS VARCHAR) AS dt, CAST(round(CAST(close AS DECIMAL(38,9)), 6) AS DOUBLE) AS close, round(ret, 8) AS ret FROM sql_returns")
def _(spark, d):
    r = M.daily_returns(V.prices_long(spark, d))
    return r.select("symbol", F.col("dt").cast("string").alias("dt"), R.round_half_up(F.col("close"), 6).alias("close"), F.round("ret", 8).alias("ret"))


def _price_features_sql(rel):
    return f"""
  WITH r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back
             FROM {rel} WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
  g AS (SELECT symbol, count(*) AS days, stddev_samp(ret) AS sa, sum(ret) AS su, stddev_samp(ret) FILTER (back <= 30) AS s30,
               max(close) FILTER (back = 1) AS last, max(close) FILTER (back = 22) AS mon, arg_max(close, back) AS first FROM r GROUP BY 1)
  SELECT symbol, days, CASE WHEN days > 30 THEN s30 WHEN days < 30 THEN sa END AS vol_30d,
         CASE WHEN days >= 22 THEN last / mon - 1 ELSE su END AS ret_1m, last / first - 1 AS ret_first_last FROM g"""


VIEWS["sql_price_features"] = _price_features_sql("prices_long")
VIEWS["sql_price_features_month"] = _price_features_sql("prices")
VIEWS["sql_price_features_short"] = _price_features_sql("(SELECT * FROM prices WHERE dt >= DATE '2024-01-12')")


def _short(spark, d):
    return V.prices(spark, d).filter("dt >= date'2024-01-12'")


@query("f2_vol_30d", """
  SELECT 'long' AS series, symbol, days, round(vol_30d, 8) AS vol_30d FROM sql_price_features
  UNION ALL SELECT 'month', symbol, days, round(vol_30d, 8) FROM sql_price_features_month
  UNION ALL SELECT 'short', symbol, days, round(vol_30d, 8) FROM sql_price_features_short""")
def _(spark, d):
    f = lambda p, n: M.price_features(p).select(F.lit(n).alias("series"), "symbol", "days", F.round("vol_30d", 8).alias("vol_30d"))
    return f(V.prices_long(spark, d), "long").unionByName(f(V.prices(spark, d), "month")).unionByName(f(_short(spark, d), "short"))


@query("f3_ret_1m", """
  SELECT 'long' AS series, symbol, round(ret_1m, 8) AS ret_1m FROM sql_price_features
  UNION ALL SELECT 'month', symbol, round(ret_1m, 8) FROM sql_price_features_month
  UNION ALL SELECT 'short', symbol, round(ret_1m, 8) FROM sql_price_features_short""")
def _(spark, d):
    f = lambda p, n: M.price_features(p).select(F.lit(n).alias("series"), "symbol", F.round("ret_1m", 8).alias("ret_1m"))
    return f(V.prices_long(spark, d), "long").unionByName(f(V.prices(spark, d), "month")).unionByName(f(_short(spark, d), "short"))


@query("f4_ret_first_last", "SELECT symbol, round(ret_first_last, 8) AS ret_first_last FROM sql_price_features")
def _(spark, d):
    return M.price_features(V.prices_long(spark, d)).select("symbol", F.round("ret_first_last", 8).alias("ret_first_last"))


@query("e45_parametric_var", """
  WITH g AS (SELECT portfolio_id, stddev_samp((price - avg_cost) / avg_cost) * sqrt(count(*)) AS vol, sum(value) AS tv FROM holdings GROUP BY 1)
  SELECT portfolio_id, round(vol, 6) AS volatility, round(tv * vol * 1.645::DOUBLE, 2) AS var_95, round(vol * 1.645::DOUBLE * 100, 4) AS max_loss_pct FROM g""")
def _(spark, d):
    return M.parametric_var(V.holdings(spark, d))


@query("e46_historical_var", """
  WITH r AS (SELECT symbol, dt, close / lag(close) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM prices),
  p AS (SELECT portfolio_id, security_id % 15 AS symbol, sum(value) AS v FROM holdings GROUP BY 1, 2),
  w AS (SELECT *, sum(v) OVER (PARTITION BY portfolio_id) AS tv FROM p),
  x AS (SELECT portfolio_id, tv, dt, sum(ret * v / tv) AS r FROM w JOIN r USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2, 3)
  SELECT portfolio_id, count(*) AS days, round(abs(quantile_cont(r, 0.05) * tv), 2) AS var_95, round(abs(quantile_cont(r, 0.01) * tv), 2) AS var_99
  FROM x GROUP BY portfolio_id, tv""")
def _(spark, d):
    h = V.holdings(spark, d).select("portfolio_id", (F.col("security_id") % 15).alias("symbol"), "value")
    return M.historical_var(h, V.prices(spark, d))


VIEWS["sql_basics"] = f"""
  SELECT s_suppkey AS symbol, s_name AS company, ([{", ".join(repr(x) for x in V.SECTORS)}])[1 + s_suppkey % 10] AS sector,
         CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey + 1) * 1.1e9::DOUBLE END AS marketCap, CAST(s_suppkey % 40 AS DOUBLE) AS trailingPE,
         (s_suppkey % 20) / 10.0::DOUBLE AS beta FROM supplier"""


def collected(spark, d):
    s = V.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    basics = s.select(k.alias("symbol"), F.col("s_name").alias("company"), V.pick(V.SECTORS, k % 10).alias("sector"),
                      F.when(k % 7 != 0, (k + 1) * 1.1e9).alias("marketCap"), (k % 40).cast("double").alias("trailingPE"),
                      (k % 20 / 10.0).alias("beta"))
    rows = V.provider_rows(spark, d).select(
        (F.col("ticker") * 2).alias("symbol"), "provider", "fetch_ts", "fact_id", F.col("raw_total").alias("total_esg"),
        F.col("raw_e").alias("environment_score"), F.col("raw_s").alias("social_score"), F.col("raw_g").alias("governance_score"))
    return M.collect_features(basics, V.prices_long(spark, d), rows)


@query("j13_collect_features", """
  WITH l AS (SELECT * FROM (SELECT ticker * 2 AS symbol, provider, raw_total, raw_e, raw_s, raw_g,
      row_number() OVER (PARTITION BY ticker ORDER BY CASE provider WHEN 'yahoo' THEN 0 ELSE 1 END, fetch_ts DESC, fact_id DESC) AS rn
      FROM provider_rows WHERE provider IN ('yahoo', 'finnhub') AND coalesce(raw_total, raw_e, raw_s, raw_g) IS NOT NULL) WHERE rn = 1),
  p AS (SELECT b.*, CASE WHEN marketCap > 50e9 THEN 10 WHEN marketCap < 5e9 AND marketCap <> 0 THEN -10 ELSE 0 END AS adj, x.e, x.s, x.g
        FROM sql_basics b JOIN lk_sector_esg_proxy_collect x ON x.sector = CASE WHEN b.sector IN (SELECT sector FROM lk_sector_esg_proxy_collect) THEN b.sector ELSE 'Other' END),
  q AS (SELECT *, greatest(0, least(100, e + adj)) AS pe, greatest(0, least(100, s + adj)) AS ps, greatest(0, least(100, g + adj)) AS pg FROM p)
  SELECT q.symbol, company, sector, marketCap, trailingPE, beta, round(vol_30d, 8) AS vol_30d, round(ret_1m, 8) AS ret_1m,
     CASE WHEN l.provider IS NULL THEN round((pe + ps + pg) / 3, 1) ELSE raw_total END AS total_esg,
     CASE WHEN l.provider IS NULL THEN pe ELSE raw_e END AS environment_score, CASE WHEN l.provider IS NULL THEN ps ELSE raw_s END AS social_score,
     CASE WHEN l.provider IS NULL THEN pg ELSE raw_g END AS governance_score, coalesce(l.provider, 'sector_proxy') AS source, l.provider IS NULL AS imputed,
     coalesce(l.provider, 'imputed_from_sector(' || sector || ')') AS label_note
  FROM q LEFT JOIN sql_price_features f ON f.symbol = q.symbol LEFT JOIN l ON l.symbol = q.symbol""")
def _(spark, d):
    return collected(spark, d).withColumn("vol_30d", F.round("vol_30d", 8)).withColumn("ret_1m", F.round("ret_1m", 8))
