"""The same inputs as ``views`` in SQL, for the cross-check on another engine."""

from __future__ import annotations

from .views import ISINS, NAMES, SECTORS


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_HEADS = [
    "Stock Name,ISIN,Quantity,Average buy price,Buy value,Closing price,Closing value",
    "Symbol,ISIN,Qty,Avg. Cost,LTP,Current Value,P&L",
    "Company Name,Shares,Buy Price,Current Price,Total Value",
    "Alpha , Security ,Beta, Net Qty",
    "Scrip/Contract,Units,Rate,Market Value as of last trading day,Exchange",
]

VIEWS = {
    "holdings": f"""
        SELECT o_custkey AS portfolio_id,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS holding_id,
               l_partkey AS security_id,
               ({_list(NAMES)})[1 + l_partkey % 40] AS stock_name,
               ({_list(SECTORS)})[1 + l_partkey % 10] AS sector,
               l_quantity AS quantity, p_retailprice AS price,
               l_extendedprice / l_quantity AS avg_cost, l_extendedprice AS invested,
               l_quantity * p_retailprice AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "holdings_dirty": f"""
        SELECT portfolio_id, holding_id, security_id,
               CASE WHEN security_id % 17 = 0 THEN NULL WHEN security_id % 19 = 0 THEN '  ' ELSE stock_name END AS stock_name,
               CASE WHEN security_id % 3 = 0 THEN 'SYM' || security_id END AS symbol,
               ({_list(ISINS)})[1 + security_id % 5] AS isin,
               CASE WHEN security_id % 11 <> 0 THEN sector END AS sector,
               CASE WHEN security_id % 29 = 0 THEN 0.0::DOUBLE ELSE quantity END AS quantity,
               CASE WHEN security_id % 5 <> 0 THEN price END AS current_price,
               CASE WHEN security_id % 4 = 0 THEN round(price * 0.98::DOUBLE, 2) END AS prev_close,
               CASE WHEN security_id % 6 <> 0 THEN round(avg_cost, 9) END AS avg_price,
               CASE WHEN security_id % 2 <> 0 THEN round(value, 2) END AS current_value,
               CASE WHEN security_id % 7 <> 0 THEN invested END AS invested_value,
               CASE WHEN security_id % 9 <> 0 THEN round(value - invested, 2) END AS pnl,
               CASE WHEN security_id % 8 = 0 THEN (security_id % 13 - 6) / 2.0::DOUBLE END AS change_pct
        FROM holdings""",
    "raw_numbers": r"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
               CASE l_linenumber
                 WHEN 1 THEN '₹' || regexp_replace(x, '([0-9])([0-9]{3})\.', '\1,\2.')
                 WHEN 2 THEN '(' || x || ')' WHEN 3 THEN q || '%' WHEN 4 THEN '  ' || x || ' '
                 WHEN 5 THEN '$-' || x WHEN 6 THEN '' WHEN 7 THEN '€ ''' || q || '''' END AS raw
        FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q,
                     CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS x FROM lineitem)""",
    "prices": """
        SELECT user_id AS symbol, CAST(ts AS DATE) AS dt, 100 + arg_max(value, (ts, event_id)) AS close
        FROM events GROUP BY 1, 2""",
    "prices_long": """
        SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS close
        FROM lineitem GROUP BY 1, 2""",
    "provider_rows": """
        SELECT user_id AS ticker,
               CASE event_type WHEN 'click' THEN 'yahoo' WHEN 'view' THEN 'finnhub' WHEN 'purchase' THEN 'rapidapi'
                               WHEN 'signup' THEN 'fmp' ELSE 'error' END AS provider,
               event_id AS fact_id,
               CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE WHEN event_id % 11 <> 0 THEN CAST((event_id * 7 + 1) % 51 AS DOUBLE) END AS raw_e,
               CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE WHEN event_id % 17 <> 0 THEN CAST((event_id * 11 + 3) % 51 AS DOUBLE) END AS raw_s,
               CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE WHEN event_id % 19 <> 0 THEN CAST((event_id * 5 + 2) % 51 AS DOUBLE) END AS raw_g,
               CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE WHEN event_id % 3 <> 0 THEN CAST(event_id * 3 % 51 AS DOUBLE) END AS raw_total,
               ts AS fetch_ts
        FROM events""",
    "company_esg": """
        SELECT s_suppkey + 120 AS ticker, CAST(35 + s_suppkey * 7 % 60 AS DOUBLE) AS e, CAST(30 + s_suppkey * 11 % 65 AS DOUBLE) AS s,
               CAST(40 + s_suppkey * 13 % 55 AS DOUBLE) AS g, CAST(35 + s_suppkey * 17 % 55 AS DOUBLE) AS total,
               CASE WHEN s_suppkey % 3 = 0 THEN 'Leader' ELSE 'Average' END AS tier
        FROM supplier""",
    "features": f"""
        SELECT k AS symbol, ({_list(SECTORS)})[1 + k % 10] AS sector,
               CASE WHEN k % 19 <> 0 THEN p_retailprice * k * 1e6::DOUBLE END AS marketCap,
               CASE WHEN k % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS trailingPE,
               0.5::DOUBLE + (k % 30) / 20.0::DOUBLE AS beta, (k % 50) / 1000.0::DOUBLE AS vol_30d,
               ((k * 13) % 41 - 20) / 100.0::DOUBLE AS ret_1m,
               CASE WHEN k % 23 <> 0 THEN CAST(env AS DOUBLE) END AS environment_score,
               CASE WHEN k % 29 <> 0 THEN CAST(soc AS DOUBLE) END AS social_score,
               CASE WHEN k % 31 <> 0 THEN CAST(gov AS DOUBLE) END AS governance_score,
               CASE WHEN k % 37 <> 0 THEN round(0.4::DOUBLE * env + 0.3::DOUBLE * soc + 0.3::DOUBLE * gov + (p_size % 5 - 2), 2) END AS total_esg,
               k % 4 = 0 AS imputed
        FROM (SELECT *, p_partkey AS k, 30 + (p_partkey * 17) % 60 AS env, 25 + (p_partkey * 29) % 65 AS soc,
                     40 + (p_partkey * 11) % 50 AS gov FROM part)""",
    "predictions": """
        SELECT p_partkey AS security_id, 45 + (p_partkey * 19) % 200 / 20.0::DOUBLE AS predicted,
               (p_partkey % 10) / 10.0::DOUBLE AS imputation_ratio,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(30 + p_partkey * 3 % 50 AS DOUBLE) END AS m_e,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(35 + p_partkey * 7 % 50 AS DOUBLE) END AS m_s,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(40 + p_partkey * 9 % 50 AS DOUBLE) END AS m_g
        FROM part WHERE p_size > 30""",
    "securities": """
        SELECT symbol AS security_id, symbol % 400 AS ticker, CASE WHEN symbol % 9 <> 0 THEN marketCap END AS market_cap FROM features""",
    "market_facts": f"""
        SELECT user_id AS symbol, CASE event_type WHEN 'click' THEN 'nse' WHEN 'view' THEN 'yahoo' WHEN 'purchase' THEN 'fmp'
                 WHEN 'signup' THEN 'iex' ELSE 'error' END AS provider, event_id % 4 <> 0 AND event_type <> 'error' AS ok,
               value * 1e8::DOUBLE AS market_cap, ({_list(SECTORS)})[1 + event_id % 10] AS sector,
               (['High', 'Medium', 'Low'])[1 + event_id % 3] AS data_quality, ts AS fetch_ts FROM events""",
    "applicants": """
        SELECT c_custkey AS applicant_id, 20000 + 10 * greatest(c_acctbal, 0.0::DOUBLE) AS income,
               CAST(c_custkey % 12 AS INT) AS employment_years, (c_custkey % 80) / 100.0::DOUBLE AS debt_to_income,
               (c_custkey % 95) / 100.0::DOUBLE AS credit_utilization, CAST(c_custkey % 4 AS INT) AS late_payments_last_2y,
               CAST(c_custkey % 120 AS INT) AS credit_history_months,
               coalesce(round(total / 10, 2), 0.0::DOUBLE) AS existing_debt
        FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "broker_lines": f"""
        SELECT f AS file_id, x.pos AS pos, x.line AS line FROM (
          SELECT f, unnest([
            {{'pos': 1::BIGINT, 'line': 'Client,' || f || ',Account'}}, {{'pos': 2, 'line': ''}},
            {{'pos': 3, 'line': CASE f % 3 WHEN 0 THEN 'Realised trades' WHEN 1 THEN 'Summary of P&L' END}},
            {{'pos': 4, 'line': CASE WHEN f % 3 = 0 THEN head END}},
            {{'pos': 5, 'line': CASE WHEN f % 3 = 0 THEN 'Old Stock,1,2,3,3,3,3' END}},
            {{'pos': 6, 'line': CASE WHEN f % 3 = 0 THEN 'Unrealised trades (Holdings as on 2024-01-31),,' END}},
            {{'pos': 7, 'line': CASE WHEN f % 3 <> 2 OR f % 5 <> 3 THEN head END}},
            {{'pos': 9000000000000000, 'line': 'Total,1,2,3,4'}},
            {{'pos': 9000000000000001, 'line': CASE WHEN f % 6 = 0 THEN 'Realised trades,,' END}},
            {{'pos': 9000000000000002, 'line': CASE WHEN f % 6 = 0 THEN 'Sold Stock,1,2,3,4,5,6' END}}]) AS x
          FROM (SELECT c_custkey AS f, ({_list(_HEADS)})[1 + c_custkey % 5] AS head FROM customer))
        WHERE x.line IS NOT NULL
        UNION ALL
        SELECT f, 1000 + l_orderkey * 10 + l_linenumber,
          CASE f % 5
            WHEN 0 THEN concat_ws(',', nm, 'INE0', q, CAST(x / 3 AS DECIMAL(18,2)), '(' || CAST(x AS DECIMAL(18,2)) || ')',
                                  CAST(x / 9 AS DECIMAL(18,2)), CAST(x * 2 AS DECIMAL(18,2)))
            WHEN 1 THEN concat_ws(',', nm, 'INE1', q, CAST(x AS DECIMAL(18,2)), '₹' || CAST(x / 7 AS DECIMAL(18,2)),
                                  CAST(x * 3 AS DECIMAL(18,2)), CAST(x - 30000 AS DECIMAL(18,2)))
            WHEN 2 THEN concat_ws(',', nm, q, CAST(x AS DECIMAL(18,2)), CAST(x / 7 AS DECIMAL(18,2)))
            WHEN 3 THEN concat_ws(',', nm, q, 'text', q, 'extra', q)
            ELSE concat_ws(',', nm, q, 'bad-number', CAST(x AS DECIMAL(18,2)), 'NSE') END
        FROM (SELECT *, o_custkey AS f, l_extendedprice AS x, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q,
                CASE WHEN l_partkey % 31 = 0 THEN 'N/A' WHEN l_partkey % 37 = 0 THEN 'Total Gas Ltd'
                     ELSE ({_list(NAMES)})[1 + l_partkey % 40] END AS nm
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}
