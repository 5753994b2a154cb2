"""Queries: broker files and cleaning of raw holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import intake as N
from . import views as V
from .registry import query
from .sql_views import VIEWS


def _alt(words):
    return "|".join(w.replace("(", "\\(") for w in words)


_WORDS = "[" + ", ".join(L.sql_literal(w) for w in L.HEADER_WORDS) + "]"
VIEWS["sql_facts"] = f"""
  WITH c AS (SELECT *, lower(line) AS low, list_transform(string_split(line, ','), lambda c: trim(c)) AS cells FROM broker_lines),
  f AS (SELECT *, trim(line) = '' AS blank, len(list_filter(cells, lambda c: c <> '')) AS nonempty, len(cells) - 1 AS commas,
          regexp_matches(low, 'unrealised|unrealized') AND regexp_matches(low, 'trades|holdings|as on') AS unreal,
          len(list_filter(cells, lambda c: len(list_filter({_WORDS}, lambda w: contains(lower(c), w))) > 0)) AS sc,
          len(list_filter(cells, lambda c: c <> '' AND NOT regexp_full_match(regexp_replace(c, '[.\\-]', '', 'g'), '[0-9]+'))) AS texty,
          lower(cells[1]) AS first FROM c),
  s AS (SELECT *, blank OR regexp_matches(low, '{_alt(L.PREAMBLE_WORDS)}') OR (regexp_matches(low, '{_alt(L.SECTION_TITLES)}') AND commas < 2) OR len(cells) < 3 AS skip FROM f)
  SELECT file_id, pos, line, cells, blank, commas,
     CASE WHEN blank OR nonempty > 3 THEN NULL WHEN unreal THEN 'unrealised'
          WHEN regexp_matches(low, 'realised|realized') AND contains(low, 'trades') THEN 'realised' END AS section,
     CASE WHEN skip THEN 0 ELSE sc END AS score, NOT skip AND len(cells) >= 4 AND texty >= 2 AS wide_text,
     NOT blank AND NOT regexp_matches(first, '^({_alt(L.TOTAL_WORDS)})') AND first NOT IN ('', 'na', 'n/a', 'null') AS is_row FROM s"""
VIEWS["sql_sections"] = """
  WITH t AS (SELECT * FROM sql_facts WHERE section IS NOT NULL),
  a AS (SELECT file_id, coalesce(max(pos) FILTER (section = 'unrealised'), max(pos)) AS start FROM t GROUP BY 1)
  SELECT a.file_id, a.start, min(t.pos) FILTER (t.pos > a.start) AS "end", max(t.commas) FILTER (t.pos = a.start) BETWEEN 1 AND 2 AS drop_title
  FROM a JOIN t USING (file_id) GROUP BY 1, 2"""
VIEWS["sql_marked"] = """
  SELECT f.*, coalesce(f.pos >= s.start AND (s."end" IS NULL OR f.pos < s."end") AND NOT (s.drop_title AND f.pos = s.start), true) AS in_section
  FROM sql_facts f LEFT JOIN sql_sections s USING (file_id)"""


def _part(n, cond):
    return f"""count(*) FILTER ({cond}) AS {n}_n, coalesce(min(pos) FILTER ({cond} AND score >= 3),
      arg_max(pos, (score, -pos)) FILTER ({cond} AND score >= 1), min(pos) FILTER ({cond} AND wide_text)) AS {n}_h, max(pos) FILTER ({cond} AND is_row) AS {n}_last"""


VIEWS["sql_headers"] = f"""
  WITH g AS (SELECT file_id, count(*) AS n_rows, count(DISTINCT pos) FILTER (NOT blank) AS nb, {_part('s', 'in_section')}, {_part('w', 'true')} FROM sql_marked GROUP BY 1),
  a AS (SELECT *, s_n < 3 AS short, CASE WHEN s_n < 3 THEN w_h ELSE s_h END AS head1, CASE WHEN s_n < 3 THEN w_last ELSE s_last END AS last1 FROM g),
  b AS (SELECT *, coalesce(last1 > head1, false) AS ok1 FROM a),
  c AS (SELECT *, NOT ok1 AND NOT short AND s_n < w_n AND head1 IS NOT NULL AND coalesce(w_last > w_h, false) AS ok2 FROM b)
  SELECT file_id, CASE WHEN ok1 THEN head1 WHEN ok2 THEN w_h ELSE head1 END AS header_pos, CASE WHEN ok1 THEN short ELSE true END AS whole_file,
     CASE WHEN n_rows < 2 OR nb < 2 THEN 'too short' WHEN head1 IS NULL THEN 'no header' WHEN ok1 OR ok2 THEN 'ok' ELSE 'no data rows' END AS status FROM c"""
_TOKENS = {}
for _, _b, _t in L.TABLES["broker_signature"][1]:
    _TOKENS.setdefault(_b, []).append(_t.lower())
_BROKER = "CASE " + " ".join(
    "WHEN " + " + ".join(f"CAST(contains(h, {L.sql_literal(t)}) AS INT)" for t in ts) + f" >= {len(ts)} * 0.6 THEN '{b}'" for b, ts in _TOKENS.items()) + " ELSE 'Generic' END"
_IDX = ", ".join(f"list_position(list_transform(header, lambda c: list_contains([{', '.join(L.sql_literal(a) for a in al)}], c)), true) AS i_{f}"
                 for f, al in L.COLUMN_ALIAS)
VIEWS["sql_mapping"] = f"""
  WITH h AS (SELECT m.file_id, max(m.cells) AS header FROM sql_marked m JOIN sql_headers x ON x.file_id = m.file_id AND x.header_pos = m.pos AND x.status = 'ok' GROUP BY 1)
  SELECT file_id, header, {_BROKER} AS broker, {_IDX} FROM (SELECT *, lower(array_to_string(header, ' ')) AS h FROM h)"""
_NUM = ", ".join(
    f"CASE WHEN i_{f} IS NOT NULL THEN coalesce(TRY_CAST(regexp_replace(CASE WHEN starts_with(cells[i_{f}], '(') AND ends_with(cells[i_{f}], ')') THEN '-' || cells[i_{f}][2:-2] "
    f"ELSE coalesce(cells[i_{f}], '') END, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0) END AS {f}" for f in N.NUMERIC_FIELDS)
VIEWS["sql_broker_rows"] = f"""
  SELECT m.file_id, m.pos, p.broker, CASE WHEN i_stock_name IS NOT NULL THEN coalesce(cells[i_stock_name], '') END AS stock_name, {_NUM}
  FROM sql_marked m JOIN sql_headers h ON h.file_id = m.file_id AND h.status = 'ok' JOIN sql_mapping p ON p.file_id = m.file_id
  WHERE is_row AND m.pos > h.header_pos AND (h.whole_file OR m.in_section)"""


def files(spark, d):
    return N.BrokerFiles(V.broker_lines(spark, d))


@query("b1_select_section", """
  SELECT file_id, count(*) AS lines, count(*) FILTER (in_section) AS section_lines, min(pos) FILTER (in_section) AS first_pos FROM sql_marked GROUP BY 1""")
def _(spark, d):
    s = F.col("in_section")
    return files(spark, d).marked.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(s).alias("section_lines"),
                                                         F.min(F.when(s, F.col("pos"))).alias("first_pos"))


@query("b2_section_or_whole", "SELECT file_id, whole_file, status FROM sql_headers")
def _(spark, d):
    return files(spark, d).headers.select("file_id", "whole_file", "status")


@query("b3_find_header", """
  SELECT h.file_id, h.header_pos, h.status, coalesce(array_to_string(m.header, '|'), '') AS header FROM sql_headers h LEFT JOIN sql_mapping m USING (file_id)""")
def _(spark, d):
    f = files(spark, d)
    return f.headers.join(f.mapping, "file_id", "left").select(
        "file_id", "header_pos", "status", F.coalesce(F.array_join("header", "|"), F.lit("")).alias("header"))


@query("b4_detect_broker", "SELECT file_id, broker FROM sql_mapping")
def _(spark, d):
    return files(spark, d).mapping.select("file_id", "broker")


@query("b5_map_columns", "SELECT file_id, " + ", ".join(f"coalesce(header[i_{f}], '') AS {f}" for f in N.FIELDS) + " FROM sql_mapping")
def _(spark, d):
    return files(spark, d).mapping.select("file_id", *[F.coalesce(F.get("header", F.col("i_" + f)), F.lit("")).alias(f) for f in N.FIELDS])


@query("b6_extract_rows", "SELECT * FROM sql_broker_rows")
def _(spark, d):
    return files(spark, d).rows


_MAPPED = ", ".join(f"CASE WHEN i_{f} IS NOT NULL THEN '{f}=' || header[i_{f}] END" for f in N.FIELDS)


@query("b18_upload_report", f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos, stock_name) AS rn FROM sql_broker_rows),
  s AS (SELECT file_id, count(*) AS n, string_agg(stock_name, ' | ' ORDER BY rn) FILTER (rn <= 3) AS sample FROM r GROUP BY 1)
  SELECT h.file_id, h.status, m.broker, coalesce(concat_ws(', ', {_MAPPED}), '') AS columns_mapped, coalesce(s.n, 0) AS rows_parsed, coalesce(s.sample, '') AS sample
  FROM sql_headers h LEFT JOIN sql_mapping m USING (file_id) LEFT JOIN s USING (file_id)""")
def _(spark, d):
    return N.upload_report(files(spark, d))


# cleaning
@query("b9_derive_values", """
  SELECT portfolio_id, holding_id, round(coalesce(current_value, current_price * quantity), 4) AS current_value,
         round(coalesce(invested_value, avg_price * quantity), 4) AS invested_value FROM holdings_dirty""")
def _(spark, d):
    return N.derive_values(V.holdings_dirty(spark, d)).select(
        "portfolio_id", "holding_id", F.round("current_value", 4).alias("current_value"), F.round("invested_value", 4).alias("invested_value"))


@query("b10_drop_unnamed", "SELECT portfolio_id, holding_id, stock_name FROM holdings_dirty WHERE trim(stock_name) <> ''")
def _(spark, d):
    return N.drop_unnamed(V.holdings_dirty(spark, d)).select("portfolio_id", "holding_id", "stock_name")


VIEWS["sql_repaired"] = """
  WITH a AS (SELECT *, quantity IS NOT NULL AND quantity <> 0 AS act FROM holdings_dirty WHERE trim(stock_name) <> ''),
  b AS (SELECT *, coalesce(act AND prev_close > 0 AND current_price IS NULL, false) AS p FROM a),
  c AS (SELECT *, p AND current_value IS NULL AS cp, CASE WHEN p AND current_value IS NULL THEN prev_close * quantity ELSE current_value END AS cv1 FROM b),
  e AS (SELECT *, coalesce(act AND invested_value IS NULL AND cv1 - pnl > 0, false) AS i FROM c),
  f AS (SELECT *, CASE WHEN i THEN cv1 - pnl ELSE invested_value END AS inv FROM e),
  g AS (SELECT *, coalesce(act AND cv1 IS NULL AND inv + pnl > 0, false) AS c FROM f),
  h AS (SELECT *, CASE WHEN c THEN inv + pnl ELSE cv1 END AS cv FROM g)
  SELECT portfolio_id, holding_id, i, c, p, cp, cv, inv, coalesce(act AND avg_price IS NULL AND inv > 0, false) AS b, coalesce(act AND current_price IS NULL AND cv > 0, false) AS s,
         CASE WHEN act AND avg_price IS NULL AND inv > 0 THEN inv / quantity ELSE avg_price END AS avg_price,
         CASE WHEN act AND current_price IS NULL AND cv > 0 THEN cv / quantity WHEN p THEN prev_close ELSE current_price END AS current_price,
         coalesce(cv > 0, false) OR coalesce(inv > 0, false) AS worth FROM h"""
_REP = "portfolio_id, holding_id, round(cv, 4) AS current_value, round(inv, 4) AS invested_value, round(avg_price, 9) AS avg_price, round(current_price, 9) AS current_price"


def _rep(df):
    return df.select("portfolio_id", "holding_id", F.round("current_value", 4).alias("current_value"), F.round("invested_value", 4).alias("invested_value"),
                     F.round("avg_price", 9).alias("avg_price"), F.round("current_price", 9).alias("current_price"))


@query("b11_repair_values", f"SELECT {_REP} FROM sql_repaired")
def _(spark, d):
    return _rep(N.repair_values(N.drop_unnamed(V.holdings_dirty(spark, d))))


@query("b12_drop_worthless", f"SELECT {_REP} FROM sql_repaired WHERE worth")
def _(spark, d):
    return _rep(N.clean(V.holdings_dirty(spark, d)))


@query("b13_cleaning_audit", """
  WITH l AS (SELECT portfolio_id, unnest([CASE WHEN p THEN 'Calculated Missing Sell Prices' END, CASE WHEN cp THEN 'Calculated Missing Current Values' END,
      CASE WHEN i THEN 'Calculated Missing Invested Values' END, CASE WHEN c THEN 'Calculated Missing Current Values' END,
      CASE WHEN b THEN 'Calculated Missing Buy Prices' END, CASE WHEN s THEN 'Calculated Missing Sell Prices' END,
      CASE WHEN NOT worth THEN 'Rows Removed (Insufficient Data)' END]) AS category FROM sql_repaired
    UNION ALL SELECT portfolio_id, 'Removed Rows (Missing Stock Name)' FROM holdings_dirty WHERE coalesce(trim(stock_name), '') = '')
  SELECT portfolio_id, category, count(*) AS changes FROM l WHERE category IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return N.audit_counts(N.cleaning_audit(V.holdings_dirty(spark, d)))


def _wide(spark, d):
    """Holdings with price columns whose headers are dates."""
    h = V.holdings(spark, d)
    k, p = F.col("security_id"), F.col("price")
    return h.select("portfolio_id", "holding_id", F.when(k % 2 == 0, F.round(p * 0.9, 2)).alias("Prev Close"),
                    F.when(k % 3 == 0, p + 1).alias("2024-01-05"), F.when(k % 5 == 0, p + 2).otherwise(0.0).alias("05-02-2024"),
                    F.when(k % 7 == 0, p + 3).alias("Mar 01, 2024"), "quantity")


VIEWS["sql_wide"] = """
  SELECT portfolio_id, holding_id, CASE WHEN security_id % 2 = 0 THEN round(price * 0.9::DOUBLE, 2) END AS pc, CASE WHEN security_id % 3 = 0 THEN price + 1 END AS a,
         CASE WHEN security_id % 5 = 0 THEN price + 2 ELSE 0 END AS b, CASE WHEN security_id % 7 = 0 THEN price + 3 END AS c FROM holdings"""


@query("b14_unpivot_date_prices", """
  SELECT portfolio_id, holding_id, 'Prev Close' AS header, NULL::VARCHAR AS dt, pc AS price FROM sql_wide WHERE pc > 0
  UNION ALL SELECT portfolio_id, holding_id, '2024-01-05', '2024-01-05', a FROM sql_wide WHERE a > 0
  UNION ALL SELECT portfolio_id, holding_id, '05-02-2024', '2024-02-05', b FROM sql_wide WHERE b > 0
  UNION ALL SELECT portfolio_id, holding_id, 'Mar 01, 2024', '2024-03-01', c FROM sql_wide WHERE c > 0""")
def _(spark, d):
    return N.unpivot_date_prices(_wide(spark, d), ["portfolio_id", "holding_id"]).withColumn("dt", F.col("dt").cast("string"))


@query("b14_newest_price", """
  SELECT portfolio_id, holding_id, CASE WHEN c > 0 THEN c WHEN b > 0 THEN b WHEN a > 0 THEN a WHEN pc > 0 THEN pc END AS price FROM sql_wide""")
def _(spark, d):
    w = _wide(spark, d)
    return w.select("portfolio_id", "holding_id", N.newest_price(w).alias("price"))


@query("b15_resolve_columns", """
  SELECT holding_id, stock_name, symbol, isin, sector, quantity, avg_price, invested_value, coalesce(TRY_CAST(replace(replace(price_text, '₹', ''), ',', '') AS DOUBLE), NULL) AS current_price,
         'Buy Value' AS value_column, 'Company Name' AS name_column
  FROM (SELECT *, '₹' || CAST(CAST(current_price AS DECIMAL(18,2)) AS VARCHAR) AS price_text FROM holdings_dirty)""")
def _(spark, d):
    h = V.holdings_dirty(spark, d)
    raw = h.select("holding_id", F.col("stock_name").alias("Company Name"), F.col("symbol").alias("NSE Symbol Code"), F.col("isin").alias("ISIN No"),
                   F.col("sector").alias("Industry"), F.col("quantity").alias("Qty"), F.col("avg_price").alias("Avg. Cost per unit"),
                   F.col("invested_value").alias("Buy Value"),
                   F.concat(F.lit("₹"), F.col("current_price").cast("decimal(18,2)").cast("string")).alias("LTP"))
    value, name = N.value_and_name_columns(raw)
    c = N.to_canonical(raw, ["holding_id"])
    return c.select("holding_id", "stock_name", "symbol", "isin", "sector", "quantity", "avg_price", "invested_value", "current_price",
                    F.lit(value).alias("value_column"), F.lit(name).alias("name_column"))


_NUMS = ["quantity", "current_price", "invested_value"]


def _salvageable(spark, d):
    h = V.holdings_dirty(spark, d).withColumn("date_price", F.col("prev_close"))
    blank = F.col("security_id") % 23 == 0  # rows with nothing at all
    gone = [F.when(~blank, F.col(c)).alias(c) for c in ("stock_name", "symbol", "isin", "quantity", "current_price", "invested_value",
                                                        "avg_price", "current_value", "pnl", "change_pct", "date_price")]
    return h.select("portfolio_id", "holding_id", *gone)


VIEWS["sql_salvaged"] = """
  WITH b AS (SELECT * REPLACE (CASE WHEN security_id % 23 <> 0 THEN stock_name END AS stock_name, CASE WHEN security_id % 23 <> 0 THEN symbol END AS symbol,
       CASE WHEN security_id % 23 <> 0 THEN isin END AS isin, CASE WHEN security_id % 23 <> 0 THEN quantity END AS quantity,
       CASE WHEN security_id % 23 <> 0 THEN current_price END AS current_price, CASE WHEN security_id % 23 <> 0 THEN invested_value END AS invested_value,
       CASE WHEN security_id % 23 <> 0 THEN avg_price END AS avg_price, CASE WHEN security_id % 23 <> 0 THEN current_value END AS current_value,
       CASE WHEN security_id % 23 <> 0 THEN pnl END AS pnl, CASE WHEN security_id % 23 <> 0 THEN change_pct END AS change_pct,
       CASE WHEN security_id % 23 <> 0 THEN prev_close END AS prev_close) FROM holdings_dirty),
  n AS (SELECT *, nullif(trim(stock_name), '') AS nm, nullif(trim(symbol), '') AS sy, nullif(trim(isin), '') AS isn,
       coalesce(quantity <> 0, false) OR coalesce(current_price <> 0, false) OR coalesce(invested_value <> 0, false) AS num,
       CASE WHEN abs(change_pct) > 1 THEN change_pct / 100 ELSE change_pct END AS chg FROM b)
  SELECT portfolio_id, holding_id, coalesce(nm, sy, isn, CASE WHEN num THEN 'Unknown (salvaged row)' END) AS stock_name,
     CASE WHEN nm IS NOT NULL THEN 'normal' WHEN sy IS NOT NULL THEN 'used_symbol' WHEN isn IS NOT NULL THEN 'used_isin' WHEN num THEN 'salvaged_numeric' END AS salvage_reason,
     CASE WHEN current_value > 0 THEN current_value WHEN quantity > 0 AND current_price > 0 THEN quantity * current_price WHEN quantity > 0 AND prev_close > 0 THEN quantity * prev_close
       WHEN prev_close > 0 AND invested_value > 0 AND avg_price > 0 THEN invested_value / avg_price * prev_close WHEN invested_value > 0 AND pnl IS NOT NULL THEN invested_value + pnl
       WHEN invested_value > 0 AND chg IS NOT NULL THEN invested_value * (1 + chg) WHEN quantity > 0 AND avg_price > 0 AND chg IS NOT NULL THEN quantity * avg_price * (1 + chg)
       WHEN quantity > 0 AND avg_price > 0 THEN quantity * avg_price WHEN invested_value > 0 THEN invested_value ELSE 0 END AS value,
     CASE WHEN current_value > 0 THEN 'direct_current_value' WHEN quantity > 0 AND current_price > 0 THEN 'qty_x_price' WHEN quantity > 0 AND prev_close > 0 THEN 'qty_x_date_price'
       WHEN prev_close > 0 AND invested_value > 0 AND avg_price > 0 THEN 'estimated_qty_x_date_price' WHEN invested_value > 0 AND pnl IS NOT NULL THEN 'invested_plus_pnl'
       WHEN invested_value > 0 AND chg IS NOT NULL THEN 'invested_x_change_pct' WHEN quantity > 0 AND avg_price > 0 AND chg IS NOT NULL THEN 'qty_x_avg_cost_with_change'
       WHEN quantity > 0 AND avg_price > 0 THEN 'qty_x_avg_cost' WHEN invested_value > 0 THEN 'invested_fallback' ELSE 'no_calculation_possible' END AS value_method FROM n"""


def valued(spark, d):
    return N.value_holding(N.salvage_identity(_salvageable(spark, d), _NUMS))


@query("b16_salvage_identity", "SELECT holding_id, portfolio_id, stock_name, salvage_reason FROM sql_salvaged WHERE stock_name IS NOT NULL")
def _(spark, d):
    return N.salvage_identity(_salvageable(spark, d), _NUMS).filter("stock_name IS NOT NULL").select(
        "holding_id", "portfolio_id", "stock_name", "salvage_reason")


@query("b19_value_holding", "SELECT holding_id, portfolio_id, round(value, 4) AS value, value_method FROM sql_salvaged")
def _(spark, d):
    return valued(spark, d).select("holding_id", "portfolio_id", F.round("value", 4).alias("value"), "value_method")


@query("b17_intake_diagnostics", """
  SELECT portfolio_id, count(*) AS rows_read, count(*) FILTER (stock_name IS NOT NULL AND value <> 0) AS rows_processed,
         count(*) FILTER (stock_name IS NOT NULL AND value <> 0 AND salvage_reason <> 'normal') AS rows_salvaged,
         count(*) FILTER (NOT (stock_name IS NOT NULL AND value <> 0)) AS rows_skipped FROM sql_salvaged GROUP BY 1""")
def _(spark, d):
    return N.intake_diagnostics(valued(spark, d))


@query("b17_intake_breakdown", """
  WITH x AS (SELECT portfolio_id, 'salvage' AS kind, salvage_reason AS item FROM sql_salvaged WHERE stock_name IS NOT NULL AND value <> 0
    UNION ALL SELECT portfolio_id, 'value_source', value_method FROM sql_salvaged WHERE stock_name IS NOT NULL AND value <> 0
    UNION ALL SELECT portfolio_id, 'skipped', CASE WHEN stock_name IS NULL THEN 'No valid name/symbol/ISIN and no meaningful numeric data' ELSE 'Zero value after trying all calculation methods' END
    FROM sql_salvaged WHERE stock_name IS NULL OR value = 0)
  SELECT portfolio_id, kind, item, count(*) AS rows FROM x GROUP BY 1, 2, 3""")
def _(spark, d):
    return N.intake_breakdown(valued(spark, d))
