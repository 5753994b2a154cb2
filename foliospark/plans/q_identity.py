"""Queries: names to sectors and tickers, and the cut-point classifiers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lookups as L
from ..functions import ratings as R
from ..functions import text as T
from ..operators import identity as I
from ..operators import market as M
from . import views as V
from .registry import query
from .sql_views import VIEWS


def names(spark, d):
    """Distinct security names derived from the part table."""
    p = V.table(spark, d, "part")
    k = F.col("p_partkey")
    base = V.pick(V.NAMES, k % 40)
    n = (F.when(k % 4 == 0, base).when(k % 4 == 1, F.concat_ws(" ", base, F.upper("p_name")))
         .when(k % 4 == 2, F.col("p_name")).otherwise(F.concat(F.lit("the "), base, F.lit(" Corp"))))
    return p.select(n.alias("name")).distinct()


VIEWS["sql_names"] = f"""
  SELECT DISTINCT CASE k % 4 WHEN 0 THEN base WHEN 1 THEN base || ' ' || upper(p_name) WHEN 2 THEN p_name
                             ELSE 'the ' || base || ' Corp' END AS name
  FROM (SELECT p_name, p_partkey AS k, ([{", ".join(L.sql_literal(n) for n in V.NAMES)}])[1 + p_partkey % 40] AS base FROM part)"""


def _classified(fn, out="sector"):
    return lambda spark, d: names(spark, d).select("name", fn(F.col("name")).alias(out))


query("c1_infer_sector", """
  WITH o AS (SELECT name, arg_min(c.sector, c.ord) AS s FROM sql_names JOIN lk_company_sector c ON contains(upper(name), c.keyword) GROUP BY 1),
  k AS (SELECT name, c.ord, c.sector, sum(c.weight) AS sc FROM sql_names JOIN lk_sector_keyword c ON contains(upper(name), c.keyword) GROUP BY ALL),
  b AS (SELECT name, arg_max(sector, (sc, -ord)) AS s FROM k GROUP BY 1)
  SELECT n.name, coalesce(o.s, b.s, 'Other') AS sector FROM sql_names n LEFT JOIN o USING (name) LEFT JOIN b USING (name)""")(
    _classified(C.infer_sector))
query("d11_join_keywords", """
  SELECT name, c.ord, c.sector, c.weight, c.keyword FROM sql_names JOIN lk_sector_keyword c ON contains(upper(name), c.keyword)""")(
    lambda spark, d: I.join_keywords(names(spark, d)))
query("c2_infer_sector_first_match", """
  SELECT n.name, coalesce(min(s) , 'Other') AS sector FROM sql_names n LEFT JOIN (
    SELECT name, arg_min(c.sector, c.ord) AS s FROM sql_names JOIN lk_first_match_keyword c ON contains(upper(name), c.keyword) GROUP BY 1) USING (name) GROUP BY 1""")(
    _classified(C.infer_sector_first_match))
query("c3_infer_sector_count", """
  WITH k AS (SELECT name, c.ord, c.sector, count(*) AS sc FROM sql_names JOIN lk_coarse_keyword c ON contains(upper(name), c.keyword) GROUP BY ALL),
  b AS (SELECT name, arg_max(sector, (sc, -ord)) AS s FROM k GROUP BY 1)
  SELECT n.name, coalesce(b.s, 'Diversified') AS sector FROM sql_names n LEFT JOIN b USING (name)""")(
    _classified(C.infer_sector_count))
query("c4_infer_sector_partial", """
  WITH k AS (SELECT name, c.ord, c.sector, sum(CASE WHEN contains(upper(name), c.keyword) THEN 2 ELSE 0 END
               + CASE WHEN len(list_filter(string_split(c.keyword, ' '), lambda w: contains(upper(name), w))) > 0 THEN 1 ELSE 0 END) AS sc
             FROM sql_names JOIN lk_partial_keyword c ON true GROUP BY ALL HAVING sc > 0),
  b AS (SELECT name, arg_max(sector, (sc, -ord)) AS s FROM k GROUP BY 1)
  SELECT n.name, coalesce(b.s, 'Other') AS sector FROM sql_names n LEFT JOIN b USING (name)""")(
    _classified(C.infer_sector_partial))
query("c5_infer_sector_simple", """
  SELECT n.name, coalesce(min(s), 'Diversified') AS sector FROM sql_names n LEFT JOIN (
    SELECT name, arg_min(c.sector, c.ord) AS s FROM sql_names JOIN lk_simple_keyword c ON contains(upper(name), c.keyword) GROUP BY 1) USING (name) GROUP BY 1""")(
    _classified(C.infer_sector_simple))
query("c7_categorize_asset", """
  SELECT n.name, coalesce(
     (SELECT arg_min(a.category, a.ord) FROM lk_asset_category a WHERE contains(upper(trim(n.name)), a.keyword) OR contains(a.keyword, upper(trim(n.name)))),
     (SELECT arg_min(c.category, c.ord) FROM lk_category_keyword c WHERE contains(lower(n.name), c.keyword)), 'large_cap_stocks') AS category
  FROM sql_names n""")(_classified(C.categorize_asset, "category"))


def _normalize_sql(match):
    return rf"""
  WITH u AS (SELECT name, trim(name) AS s, upper(trim(name)) AS u FROM sql_names),
  x AS (SELECT u.*, regexp_replace(u, '(EQ|BE|BZ)\.(NS|BO)$', '') AS base,
               regexp_extract(u, '\.(NS|BO)$') AS exchange FROM u),
  e AS (SELECT name, arg_min(k.ticker, k.ord) AS t FROM x JOIN lk_ticker_key k ON k.keyword = u GROUP BY 1),
  eb AS (SELECT name, arg_min(k.ticker, k.ord) AS t FROM x JOIN lk_ticker_key k ON k.keyword = base GROUP BY 1),
  c AS (SELECT name, arg_min(k.ticker, k.ord) AS t FROM x JOIN lk_ticker_key k ON {match} GROUP BY 1)
  SELECT x.name, CASE
     WHEN regexp_matches(u, '(EQ|BE|BZ)\.(NS|BO)$') THEN coalesce(eb.t, base || exchange)
     WHEN regexp_matches(s, '\.(NS|BO)$') THEN u WHEN regexp_matches(u, '\.(NS|BO|NYSE|NASDAQ)$') THEN s
     ELSE coalesce(e.t, c.t, regexp_replace(regexp_replace(u, '^(.+)(EQ|BE|BZ|SM|MS|GS|TS)$', '\1'), '[^\p{{L}}\p{{N}}-]', '', 'g') || '.NS') END AS ticker
  FROM x LEFT JOIN e USING (name) LEFT JOIN eb USING (name) LEFT JOIN c USING (name)"""


query("c8_normalize_ticker", _normalize_sql(
    "contains(' ' || u || ' ', ' ' || k.keyword || ' ') OR contains(' ' || k.keyword || ' ', ' ' || u || ' ')"))(
    _classified(C.normalize_ticker, "ticker"))
query("c8_normalize_ticker_substring", _normalize_sql("contains(u, k.keyword) OR contains(k.keyword, u)"))(
    _classified(lambda c: C.normalize_ticker(c, strict=False), "ticker"))

_clean = "trim(upper({}))"
for _s in L.NAME_SUFFIXES:
    _clean = f"rtrim(regexp_replace({_clean}, '{re.escape(_s)}$', ''))"


def _by_name(rel, col="name"):
    return f"""
    c AS (SELECT DISTINCT {col} AS nm, nullif({_clean.format(col)}, '') AS cl FROM {rel} WHERE {col} IS NOT NULL),
    t AS (SELECT nm, coalesce(arg_min(k.ticker, k.ord) FILTER (k.keyword = cl), arg_min(k.ticker, k.ord)) AS by_name
          FROM c JOIN lk_name_ticker k ON contains(cl, k.keyword) OR contains(k.keyword, cl) GROUP BY 1)"""


query("c9_ticker_from_name", f"""WITH {_by_name('sql_names')}
  SELECT n.name, by_name AS ticker FROM sql_names n LEFT JOIN t ON nm = name""")(_classified(C.ticker_from_name, "ticker"))


def _ids(spark, d):
    return V.holdings_dirty(spark, d).select("stock_name", "isin", "symbol").distinct()


query("c10_ticker_from_isin", """
  SELECT i.isin, k.ticker FROM (SELECT DISTINCT isin FROM holdings_dirty) i LEFT JOIN lk_isin_ticker k ON k.isin = upper(trim(i.isin))""")(
    lambda spark, d: V.holdings_dirty(spark, d).select("isin").distinct().select("isin", C.ticker_from_isin(F.col("isin")).alias("ticker")))
query("c11_resolve_ticker", f"""WITH i AS (SELECT DISTINCT stock_name, isin, symbol FROM holdings_dirty), {_by_name('i', 'stock_name')}
  SELECT i.stock_name, i.isin, i.symbol, coalesce(CASE WHEN contains(i.symbol, '.NS') OR contains(i.symbol, '.BO') THEN i.symbol END, k.ticker, by_name,
         upper(i.symbol) || '.NS', string_split(upper(nullif(trim(i.stock_name), '')), ' ')[1] || '.NS', 'UNKNOWN.NS') AS ticker
  FROM i LEFT JOIN lk_isin_ticker k ON k.isin = upper(trim(i.isin)) LEFT JOIN t ON nm = i.stock_name""")(
    lambda spark, d: _ids(spark, d).select("stock_name", "isin", "symbol", C.resolve_ticker(
        F.when(F.trim("stock_name") != "", F.col("stock_name")), F.col("isin"), F.col("symbol")).alias("ticker")))
query("c12_symbol_variants", """
  SELECT n.name, upper(replace(replace(name, '.NS', ''), '.BO', '')) AS base_symbol,
         CASE WHEN NOT contains(name, '.') AND length(name) <= 10 THEN name || '.NS' ELSE name END AS provider_symbol,
         coalesce((SELECT arg_min(k.ticker, k.ord) FROM lk_shortcut_ticker k WHERE contains(upper(n.name), k.keyword)),
                  string_split(trim(upper(name)), ' ')[1] || '.NS') AS shortcut
  FROM sql_names n""")(lambda spark, d: names(spark, d).select(
      "name", C.base_symbol(F.col("name")).alias("base_symbol"), C.provider_symbol(F.col("name")).alias("provider_symbol"),
      C.shortcut_ticker(F.col("name")).alias("shortcut")))


# provider sectors from the part table
def _provider(spark, d):
    p = V.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("symbol"),
                    F.when(k % 3 == 0, V.pick([r[0] for r in L.PROVIDER_SECTOR] + ["Conglomerates", ""], k % 14)).alias("provider_sector"),
                    V.pick(["Regional Banks", "Software - Apps", "Oilfield Gas", "Drug Makers", "Auto Parts", "Telecom", "Electric Utility",
                            "Steel Works", "Toys", None], k % 10).alias("industry"),
                    V.pick(["Banks", "information technology", "CONSTRUCTION", "Aerospace"], k % 4).alias("exchange_sector"))


VIEWS["sql_provider"] = f"""
  SELECT p_partkey AS symbol, CASE WHEN p_partkey % 3 = 0 THEN ([{", ".join(L.sql_literal(r[0]) for r in L.PROVIDER_SECTOR)}, 'Conglomerates', ''])[1 + p_partkey % 14] END AS provider_sector,
    (['Regional Banks', 'Software - Apps', 'Oilfield Gas', 'Drug Makers', 'Auto Parts', 'Telecom', 'Electric Utility', 'Steel Works', 'Toys', NULL])[1 + p_partkey % 10] AS industry,
    (['Banks', 'information technology', 'CONSTRUCTION', 'Aerospace'])[1 + p_partkey % 4] AS exchange_sector FROM part"""


@query("c6_map_provider_sector", """
  SELECT p.symbol, coalesce(m.sector, nullif(p.provider_sector, ''),
           (SELECT arg_min(k.sector, k.ord) FROM lk_industry_keyword k WHERE contains(lower(p.industry), k.keyword))) AS house_sector,
         coalesce(x.sector, p.exchange_sector) AS exchange_house_sector
  FROM sql_provider p LEFT JOIN lk_provider_sector m USING (provider_sector)
  LEFT JOIN lk_exchange_sector x ON x.exchange_sector = upper(p.exchange_sector)""")
def _(spark, d):
    x = I.map_exchange_sector(I.map_provider_sector(_provider(spark, d), "provider_sector", "industry"), "exchange_sector")
    return x.select("symbol", "house_sector", "exchange_house_sector")


@query("c21_industry_flags", """
  SELECT p.symbol, p.sector, r.flag, r.level FROM features p JOIN lk_industry_risk r USING (sector)""")
def _(spark, d):
    return I.industry_flags(V.features(spark, d).select("symbol", "sector"))


# numbers
query("b7_clean_numeric", r"""
  WITH c AS (SELECT *, regexp_replace(CASE WHEN starts_with(raw, '(') AND ends_with(raw, ')') THEN '-' || raw[2:-2] ELSE raw END, '[^0-9.\-]', '', 'g') AS t FROM raw_numbers)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw, coalesce(TRY_CAST(t AS DOUBLE), 0.0::DOUBLE) AS value FROM c""")(
    lambda spark, d: V.raw_numbers(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw",
                                                    T.clean_numeric(F.col("raw")).alias("value")))
query("b8_safe_float", r"""
  WITH c AS (SELECT *, regexp_replace(raw, '[₹$€£, "'']', '', 'g') AS t FROM raw_numbers)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw,
         coalesce(TRY_CAST(CASE WHEN contains(t, '(') AND contains(t, ')') THEN '-' || replace(replace(t, '(', ''), ')', '') ELSE t END AS DOUBLE), 0.0::DOUBLE) AS value FROM c""")(
    lambda spark, d: V.raw_numbers(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw",
                                                    T.safe_float(F.col("raw")).alias("value")))


# market caps
def _caps(cols):
    return lambda spark, d: V.features(spark, d).select("symbol", *[f(F.col("marketCap")).alias(n) for n, f in cols.items()])


def _cap_case(expr, large, mid):
    return f"CASE WHEN {expr} >= {large} THEN 'Large Cap' WHEN {expr} >= {mid} THEN 'Mid Cap' ELSE 'Small Cap' END"


query("c13_cap_class_inr", f"""
  SELECT symbol, {_cap_case('marketCap * 83 / 10000000', 20000, 5000)} AS cap_class, {_cap_case('marketCap / 10000000', 20000, 5000)} AS crore_class,
         {_cap_case('marketCap / 10000000', 25000, 7500)} AS bank_class FROM features""")(
    _caps({"cap_class": R.cap_class_inr, "crore_class": lambda c: R.cap_class_crore(c / 10_000_000),
           "bank_class": lambda c: R.cap_class_crore(c / 10_000_000, 25000, 7500)}))
query("c14_cap_class_usd", f"SELECT symbol, {_cap_case('marketCap', '1e10', '2e9')} AS cap_class FROM features")(
    _caps({"cap_class": R.cap_class_usd}))
query("c15_esg_cap_band", """
  SELECT symbol, CASE WHEN marketCap >= 5e10 THEN 'Large' WHEN marketCap >= 5e9 THEN 'Mid' ELSE 'Small' END AS band,
         CASE WHEN marketCap >= 5e10 THEN 1.1::DOUBLE WHEN marketCap >= 5e9 THEN 1.0 ELSE 0.9 END AS factor FROM features""")(
    _caps({"band": R.esg_cap_band, "factor": R.esg_cap_factor}))
query("c29_format_cap", """
  SELECT symbol, CASE WHEN marketCap >= 1e12 THEN '$' || CAST(round(marketCap / 1e12::DOUBLE, 2) AS DECIMAL(38,2)) || 'T'
                      WHEN marketCap >= 1e9 THEN '$' || CAST(round(marketCap / 1e9::DOUBLE, 2) AS DECIMAL(38,2)) || 'B'
                      WHEN marketCap > 0 THEN '$' || CAST(round(marketCap / 1e6::DOUBLE, 2) AS DECIMAL(38,2)) || 'M' END AS cap_text FROM features""")(
    _caps({"cap_text": R.format_cap}))


# ESG classifiers over security scores
def _scores(cols):
    def run(spark, d):
        f = V.features(spark, d).select("symbol", F.col("environment_score").alias("e"), F.col("social_score").alias("s"),
                                        F.col("governance_score").alias("g"))
        f = f.filter("e + s + g IS NOT NULL").withColumn("score", (F.col("symbol") % 1001) / 10.0)
        return f.select("symbol", *[c.alias(n) for n, c in cols().items()])
    return run


VIEWS["sql_scores"] = """
  SELECT symbol, environment_score AS e, social_score AS s, governance_score AS g, (symbol % 1001) / 10.0::DOUBLE AS score
  FROM features WHERE environment_score + social_score + governance_score IS NOT NULL"""


def _cases(expr, cuts, default, op=">="):
    return "CASE " + " ".join(f"WHEN {expr} {op} {c} THEN {v}" for c, v in cuts) + f" ELSE {default} END"


_STARS = _cases("score", [(80, 5), (60, 4), (40, 3), (20, 2)], 1)
query("c16_star_rating", f"SELECT symbol, {_STARS} AS stars, (['Laggard', 'Below Average', 'Average', 'Strong', 'Leader'])[{_STARS}] AS label FROM sql_scores")(
    _scores(lambda: {"stars": R.star_rating(F.col("score")), "label": R.rating_label(R.star_rating(F.col("score")))}))
query("c17_esg_risk_multiplier", f"""
  SELECT symbol, CAST({_cases("score", [(80, 0.8), (60, 0.9), (40, 1.0), (20, 1.15)], 1.3)} AS DOUBLE) AS multiplier FROM sql_scores""")(
    _scores(lambda: {"multiplier": R.esg_risk_multiplier(F.col("score"))}))
query("c18_esg_risk_level", f"""
  SELECT symbol, {_cases("score", [(80, "'Low Risk'"), (60, "'Medium Risk'"), (40, "'High Risk'")], "'Extreme Risk'")} AS level FROM sql_scores""")(
    _scores(lambda: {"level": R.esg_risk_level(F.col("score"))}))
query("c19_letter_rating", f"""
  SELECT symbol, {_cases("score", [(80, "'AAA'"), (70, "'AA'"), (60, "'A'"), (50, "'BBB'"), (40, "'BB'")], "'B'")} AS letter6,
         {_cases("score", [(90, "'AAA'"), (80, "'AA'"), (70, "'A'"), (60, "'BBB'"), (50, "'BB'"), (40, "'B'")], "'CCC'")} AS letter7 FROM sql_scores""")(
    _scores(lambda: {"letter6": R.letter_rating(F.col("score"), 6), "letter7": R.letter_rating(F.col("score"), 7)}))
query("c20_improvement_areas", """
  SELECT symbol, CASE WHEN e >= 60 AND s >= 60 AND g >= 60 THEN 'Maintain current ESG standards' ELSE concat_ws('; ',
     CASE WHEN e < 60 THEN 'Environmental practices need improvement' END, CASE WHEN s < 60 THEN 'Social responsibility initiatives required' END,
     CASE WHEN g < 60 THEN 'Governance structures need strengthening' END) END AS areas FROM sql_scores""")(
    _scores(lambda: {"areas": F.concat_ws("; ", R.improvement_areas(F.col("e"), F.col("s"), F.col("g")))}))


@query("c22_msci_to_100", """
  SELECT fact_id, round(greatest(0, least(100, 100 - raw_total * 1.8::DOUBLE)), 6) AS score FROM provider_rows WHERE raw_total IS NOT NULL""")
def _(spark, d):
    p = V.provider_rows(spark, d).filter("raw_total IS NOT NULL")
    return p.select("fact_id", F.round(R.msci_to_100(F.col("raw_total")), 6).alias("score"))


def _m(c):
    return f"greatest(0, least(100, 100 - {c} * 1.8::DOUBLE)) * CASE WHEN {c} IS NULL THEN NULL ELSE 1 END"


VIEWS["sql_snap"] = f"""
  WITH r AS (SELECT *, {_m('raw_e')} AS ye, {_m('raw_s')} AS ys, {_m('raw_g')} AS yg, {_m('raw_total')} AS yt,
               coalesce(raw_e, 0) AS e0, coalesce(raw_s, 0) AS s0, coalesce(raw_g, 0) AS g0, coalesce(raw_total, 0) AS t0 FROM provider_rows),
  x AS (SELECT ticker, provider, fact_id, fetch_ts,
     CASE WHEN provider = 'yahoo' THEN coalesce(nullif(ye, 0), 50) ELSE e0 END AS e, CASE WHEN provider = 'yahoo' THEN coalesce(nullif(ys, 0), 50) ELSE s0 END AS s,
     CASE WHEN provider = 'yahoo' THEN coalesce(nullif(yg, 0), 50) ELSE g0 END AS g,
     CASE provider WHEN 'yahoo' THEN coalesce(yt, (nullif(ye, 0) + nullif(ys, 0) + nullif(yg, 0)) / 3)
       WHEN 'finnhub' THEN CASE WHEN raw_e IS NOT NULL THEN t0 END
       WHEN 'rapidapi' THEN CASE WHEN e0 <> 0 OR s0 <> 0 OR g0 <> 0 THEN (e0 + s0 + g0) / 3 END
       WHEN 'fmp' THEN nullif(CASE WHEN t0 <> 0 THEN t0 ELSE (e0 + s0 + g0) / 3 END, 0) END AS overall FROM r)
  SELECT * FROM x WHERE overall IS NOT NULL"""


@query("c23_merge_provider_scores", """
  SELECT fact_id, ticker, provider, round(e, 4) AS e, round(s, 4) AS s, round(g, 4) AS g, round(overall, 4) AS overall FROM sql_snap""")
def _(spark, d):
    m = M.merge_provider_scores(V.provider_rows(spark, d))
    return m.select("fact_id", "ticker", "provider", *[F.round(c, 4).alias(c) for c in ("e", "s", "g", "overall")])


# stress classifiers over every order line: impact is a percentage from the line's discount and tax
def _impacts(spark, d):
    li = V.table(spark, d, "lineitem")
    pct = (F.round(F.col("l_discount") * 100) * 4 + F.round(F.col("l_tax") * 100) - F.col("l_linenumber") * 7)
    hhi = F.col("l_quantity") * F.col("l_quantity") * 4
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pct.alias("pct"), hhi.alias("hhi"))


VIEWS["sql_impacts"] = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * 100) * 4 + round(l_tax * 100) - l_linenumber * 7 AS pct,
         l_quantity * l_quantity * 4 AS hhi FROM lineitem"""
_K = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _over_impacts(cols):
    return lambda spark, d: _impacts(spark, d).select(*_K, *[c.alias(n) for n, c in cols().items()])


_KS = ", ".join(_K)
query("c24_stress_risk_level", f"""SELECT {_KS}, {_cases("abs(pct) / 100", [(0.25, "'Extreme'"), (0.15, "'High'"), (0.08, "'Medium'")], "'Low'", '>')} AS level FROM sql_impacts""")(
    _over_impacts(lambda: {"level": R.stress_risk_level(F.abs("pct") / 100)}))
query("c25_gauge_risk_level", f"""SELECT {_KS}, {_cases("abs(pct)", [(25, "'Extreme Risk'"), (15, "'High Risk'"), (8, "'Medium Risk'")], "'Low Risk'")} AS level FROM sql_impacts""")(
    _over_impacts(lambda: {"level": R.gauge_risk_level(F.col("pct"))}))
query("c26_concentration_level", f"""SELECT {_KS}, CASE WHEN hhi < 1500 THEN 'Low (well-diversified)' WHEN hhi < 2500 THEN 'Moderate' WHEN hhi < 5000 THEN 'High' ELSE 'Extreme (concentrated)' END AS level,
   CASE WHEN hhi < 1500 THEN 0 WHEN hhi < 2500 THEN 5 WHEN hhi < 5000 THEN 10 ELSE 20 END AS penalty_pct,
   CASE WHEN hhi < 1500 THEN 'Excellent' WHEN hhi < 2500 THEN 'Good' ELSE 'Moderate' END AS grade FROM sql_impacts""")(
    _over_impacts(lambda: {"level": R.concentration_level(F.col("hhi")), "penalty_pct": R.concentration_penalty_pct(F.col("hhi")),
                           "grade": R.hhi_grade(F.col("hhi"))}))
query("c27_recovery_months", f"SELECT {_KS}, round(greatest(abs(pct) / 100 / 0.125::DOUBLE * 12, 1), 6) AS months FROM sql_impacts")(
    _over_impacts(lambda: {"months": F.round(R.recovery_months(F.abs("pct") / 100), 6)}))
query("c28_var95_proxy", f"SELECT {_KS}, round(pct * 1.5::DOUBLE, 6) AS var_95 FROM sql_impacts")(
    _over_impacts(lambda: {"var_95": F.round(R.var95_proxy(F.col("pct")), 6)}))
query("c31_impact_band", f"""SELECT {_KS}, CASE WHEN abs(pct) < 10 THEN 'LOW' WHEN abs(pct) < 20 THEN 'MODERATE' WHEN abs(pct) < 30 THEN 'HIGH' ELSE 'SEVERE' END AS band FROM sql_impacts""")(
    _over_impacts(lambda: {"band": R.impact_band(F.col("pct"))}))
query("c33_diversification_label", f"""SELECT {_KS}, CASE WHEN 1 - hhi / 10000 > 0.7 THEN 'Well Diversified' WHEN 1 - hhi / 10000 < 0.4 THEN 'Concentrated' ELSE 'Moderate' END AS label FROM sql_impacts""")(
    _over_impacts(lambda: {"label": R.diversification_label(1 - F.col("hhi") / 10000)}))


def _values(words):
    return "(VALUES " + ", ".join(f"({L.sql_literal(w)})" for w in words) + ")"


@query("c30_route_request", f"""
  WITH t AS (SELECT doc_id, upper(text) AS u FROM documents),
  s AS (SELECT doc_id, count(*) AS n FROM t JOIN {_values(L.STRESS_REQUEST_WORDS)} w(k) ON contains(u, k) GROUP BY 1),
  c AS (SELECT doc_id, count(*) AS n FROM t JOIN {_values(L.CREDIT_REQUEST_WORDS)} w(k) ON contains(u, k) GROUP BY 1),
  x AS (SELECT doc_id, u, CAST(coalesce(s.n, 0) AS INT) AS stress_words, CAST(coalesce(c.n, 0) AS INT) AS credit_words FROM t LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id))
  SELECT doc_id, stress_words, credit_words, CASE WHEN (stress_words >= 2 AND stress_words > credit_words)
     OR regexp_matches(u, 'MARKET_CORRECTION|RECESSION|INFLATION|TECH_CRASH|EMERGENCY') OR contains(u, 'STRESS TESTING ANALYSIS REQUEST') THEN 'stress' ELSE 'credit' END AS route FROM x""")
def _(spark, d):
    t = V.table(spark, d, "documents").select("doc_id", C.tag_request(F.col("text")).alias("t"))
    return t.select("doc_id", "t.stress_words", "t.credit_words", "t.route")
