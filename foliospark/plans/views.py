"""The shared test tables seen as this library's inputs (holdings, prices, provider rows, ...).

Only projections, equi-joins and aggregations over whole tables: Spark prunes the scans to the columns a
query uses, and joins or broadcasts by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import sql_literal

SECTORS = ["IT Services", "Banking", "Oil & Gas", "FMCG", "Automobiles", "Pharmaceuticals",
           "Metals & Mining", "Power", "Real Estate", "Media & Entertainment"]
NAMES = [
    "Tata Motors Ltd", "HDFC Bank", "Infosys Limited", "Coal India Ltd", "Reliance Industries Ltd",
    "Suzlon Energy Limited", "State Bank of India", "Bajaj Housing Finance Limited", "Tech Mahindra Ltd",
    "Sun Pharma Advanced Research", "Oil And Natural Gas Corp", "Maruti Suzuki India Ltd", "ITC Ltd",
    "Bharti Airtel", "Tata Steel Ltd", "Larsen & Toubro Infrastructure", "UltraTech Cement Ltd",
    "DLF Limited", "Zee Entertainment Enterprises", "Acme Widgets", "GRAPHITE INDIA LTD", "RELIANCEEQ.NS",
    "SATINVEQ", "M&M", "Choice International Ltd", "Vodafone Idea Mobile Network",
    "JSW Energy Solar Power", "Godrej Consumer Products", "Central Bank of India", "Apple Inc",
    "Digital Data Systems", "Ashok Leyland Auto", "Bank", "FMCG Foods Retail Store", "TCS.NS",
    "Gandhar Oil Refinery (India) Limited", "Real Estate Property Developers",
    "Health Medicine Drug Clinic", "Steel Metal Mining", "XYZBE.BO",
]
ISINS = ["INE028A01039", "INE522F01014", "ine009a01021 ", "INE999Z99999", None]
AS_OF = "2024-01-31"


# Given schemas spare a job per table that would only read a file footer.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def pick_sql(values, index: str) -> str:
    """SQL for the index-th of fixed values."""
    return "get(array(" + ", ".join(sql_literal(v) for v in values) + f"), cast({index} as int))"


def pick(values, index: Column) -> Column:
    return F.get(F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")"), index.cast("int"))


def holdings(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    j = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(p, F.col("l_partkey") == F.col("p_partkey")))
    return j.selectExpr(
        "o_custkey AS portfolio_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) AS holding_id",
        "l_partkey AS security_id", pick_sql(NAMES, "l_partkey % 40") + " AS stock_name",
        pick_sql(SECTORS, "l_partkey % 10") + " AS sector", "l_quantity AS quantity", "p_retailprice AS price",
        "l_extendedprice / l_quantity AS avg_cost", "l_extendedprice AS invested", "l_quantity * p_retailprice AS value")


def holdings_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Holdings with gaps by rule; one row per line, canonical column names."""
    gap = lambda n, x, name: f"if(security_id % {n} <> 0, {x}, null) AS {name}"
    return holdings(spark, d).selectExpr(
        "portfolio_id", "holding_id", "security_id",
        "CASE WHEN security_id % 17 = 0 THEN null WHEN security_id % 19 = 0 THEN '  ' ELSE stock_name END AS stock_name",
        "if(security_id % 3 = 0, 'SYM' || security_id, null) AS symbol",
        pick_sql(ISINS, "security_id % 5") + " AS isin", gap(11, "sector", "sector"),
        "if(security_id % 29 = 0, 0.0D, quantity) AS quantity", gap(5, "price", "current_price"),
        "if(security_id % 4 = 0, round(price * 0.98D, 2), null) AS prev_close",
        gap(6, "round(avg_cost, 9)", "avg_price"), gap(2, "round(value, 2)", "current_value"),
        gap(7, "invested", "invested_value"), gap(9, "round(value - invested, 2)", "pnl"),
        "if(security_id % 8 = 0, (security_id % 13 - 6) / 2.0D, null) AS change_pct")


def raw_numbers(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").selectExpr(
        "*", "cast(cast(l_quantity as int) as string) AS q", "cast(cast(l_extendedprice as decimal(18,2)) as string) AS x")
    return li.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        r"""CASE l_linenumber WHEN 1 THEN '₹' || regexp_replace(x, r'([0-9])([0-9]{3})\.', r'$1,$2.')
            WHEN 2 THEN '(' || x || ')' WHEN 3 THEN q || '%' WHEN 4 THEN '  ' || x || ' ' WHEN 5 THEN '$-' || x
            WHEN 6 THEN '' WHEN 7 THEN "€ '" || q || "'" END AS raw""")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Close per symbol and day: the day's last event, found by a map-side combined max_by."""
    e = table(spark, d, "events")
    return (e.groupBy(F.col("user_id").alias("symbol"), F.col("ts").cast("date").alias("dt"))
            .agg((100 + F.max_by("value", F.struct("ts", "event_id"))).alias("close")))


def prices_long(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("dt"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close")))


def provider_rows(spark: SparkSession, d: str) -> DataFrame:
    """Landed ESG rows of several providers, as fetched (yahoo on its 0..50 risk scale)."""
    score = lambda m, off, gap, name: (
        f"CASE WHEN event_id % 13 = 0 THEN 0.0D WHEN event_id % {gap} <> 0 THEN cast((event_id * {m} + {off}) % 51 AS double) END AS {name}")
    return table(spark, d, "events").selectExpr(
        "user_id AS ticker",
        "CASE event_type WHEN 'click' THEN 'yahoo' WHEN 'view' THEN 'finnhub' WHEN 'purchase' THEN 'rapidapi' WHEN 'signup' THEN 'fmp' ELSE 'error' END AS provider",
        "event_id AS fact_id", score(7, 1, 11, "raw_e"), score(11, 3, 17, "raw_s"), score(5, 2, 19, "raw_g"),
        score(3, 0, 3, "raw_total"), "ts AS fetch_ts")


def company_esg(spark: SparkSession, d: str) -> DataFrame:
    k = "s_suppkey"
    return table(spark, d, "supplier").selectExpr(
        f"{k} + 120 AS ticker", f"cast(35 + {k} * 7 % 60 AS double) AS e", f"cast(30 + {k} * 11 % 65 AS double) AS s",
        f"cast(40 + {k} * 13 % 55 AS double) AS g", f"cast(35 + {k} * 17 % 55 AS double) AS total",
        f"if({k} % 3 = 0, 'Leader', 'Average') AS tier")


def features(spark: SparkSession, d: str) -> DataFrame:
    env, soc, gov = "(30 + (k * 17) % 60)", "(25 + (k * 29) % 65)", "(40 + (k * 11) % 50)"
    gap = lambda n, x, name: f"if(k % {n} <> 0, {x}, null) AS {name}"
    return table(spark, d, "part").withColumnRenamed("p_partkey", "k").selectExpr(
        "k AS symbol", pick_sql(SECTORS, "k % 10") + " AS sector", gap(19, "p_retailprice * k * 1e6D", "marketCap"),
        gap(7, "cast(p_size AS double)", "trailingPE"), "0.5D + (k % 30) / 20.0D AS beta", "(k % 50) / 1000.0D AS vol_30d",
        "((k * 13) % 41 - 20) / 100.0D AS ret_1m", gap(23, f"cast({env} AS double)", "environment_score"),
        gap(29, f"cast({soc} AS double)", "social_score"), gap(31, f"cast({gov} AS double)", "governance_score"),
        gap(37, f"round(0.4D * {env} + 0.3D * {soc} + 0.3D * {gov} + (p_size % 5 - 2), 2)", "total_esg"), "k % 4 = 0 AS imputed")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Stored model scores for part of the securities, with the pillars the model saw."""
    pillar = lambda m, off, name: f"if(p_partkey % 2 = 0, cast({off} + p_partkey * {m} % 50 AS double), null) AS {name}"
    return table(spark, d, "part").filter("p_size > 30").selectExpr(
        "p_partkey AS security_id", "45 + (p_partkey * 19) % 200 / 20.0D AS predicted", "(p_partkey % 10) / 10.0D AS imputation_ratio",
        pillar(3, 30, "m_e"), pillar(7, 35, "m_s"), pillar(9, 40, "m_g"))


def securities(spark: SparkSession, d: str) -> DataFrame:
    """security_id, ESG ticker and market cap (unknown for some)."""
    return features(spark, d).selectExpr("symbol AS security_id", "symbol % 400 AS ticker",
                                         "if(symbol % 9 <> 0, marketCap, null) AS market_cap")


def market_facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id AS symbol",
        "CASE event_type WHEN 'click' THEN 'nse' WHEN 'view' THEN 'yahoo' WHEN 'purchase' THEN 'fmp' WHEN 'signup' THEN 'iex' ELSE 'error' END AS provider",
        "event_id % 4 <> 0 AND event_type <> 'error' AS ok", "value * 1e8D AS market_cap",
        pick_sql(SECTORS, "event_id % 10") + " AS sector", pick_sql(["High", "Medium", "Low"], "event_id % 3") + " AS data_quality",
        "ts AS fetch_ts")


def applicants(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    debt = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    k = F.col("c_custkey")
    return (c.join(debt, k == F.col("o_custkey"), "left").select(
        k.alias("applicant_id"), (20000 + 10 * F.greatest("c_acctbal", F.lit(0.0))).alias("income"),
        (k % 12).cast("int").alias("employment_years"), ((k % 80) / 100.0).alias("debt_to_income"),
        ((k % 95) / 100.0).alias("credit_utilization"), (k % 4).cast("int").alias("late_payments_last_2y"),
        (k % 120).cast("int").alias("credit_history_months"),
        F.coalesce(F.round(F.col("total") / 10, 2), F.lit(0.0)).alias("existing_debt")))


def broker_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, pos, line): one generated broker file per customer, in several styles."""
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    f = F.col("c_custkey")
    money = lambda x: x.cast("decimal(18,2)").cast("string")
    heads = [
        "Stock Name,ISIN,Quantity,Average buy price,Buy value,Closing price,Closing value",
        "Symbol,ISIN,Qty,Avg. Cost,LTP,Current Value,P&L",
        "Company Name,Shares,Buy Price,Current Price,Total Value",
        "Alpha , Security ,Beta, Net Qty",
        "Scrip/Contract,Units,Rate,Market Value as of last trading day,Exchange",
    ]
    head = pick(heads, f % 5)
    old = F.concat(F.lit("Old Stock,1,2"), F.repeat(F.lit(",3"), 4))
    at = lambda pos, line: F.struct(F.lit(pos).cast("long").alias("pos"), line.alias("line"))
    fixed = F.array(
        at(1, F.concat(F.lit("Client,"), f.cast("string"), F.lit(",Account"))), at(2, F.lit("")),
        at(3, F.when(f % 3 == 0, "Realised trades").when(f % 3 == 1, "Summary of P&L")),
        at(4, F.when(f % 3 == 0, head)), at(5, F.when(f % 3 == 0, old)),
        at(6, F.when(f % 3 == 0, "Unrealised trades (Holdings as on 2024-01-31),,")),
        at(7, F.when((f % 3 != 2) | (f % 5 != 3), head)),
        at(9_000_000_000_000_000, F.lit("Total,1,2,3,4")),
        at(9_000_000_000_000_001, F.when(f % 6 == 0, "Realised trades,,")),
        at(9_000_000_000_000_002, F.when(f % 6 == 0, "Sold Stock,1,2,3,4,5,6")))
    frame = (c.select(f.alias("file_id"), F.explode(fixed).alias("x"))
             .select("file_id", "x.pos", "x.line").filter("line IS NOT NULL"))
    k, q, x = F.col("l_partkey"), F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice")
    name = F.when(k % 31 == 0, "N/A").when(k % 37 == 0, "Total Gas Ltd").otherwise(pick(NAMES, k % 40))
    style = F.col("o_custkey") % 5
    row = (F.when(style == 0, F.concat_ws(",", name, F.lit("INE0"), q, money(x / 3),
                                          F.concat(F.lit("("), money(x), F.lit(")")), money(x / 9), money(x * 2)))
           .when(style == 1, F.concat_ws(",", name, F.lit("INE1"), q, money(x), F.concat(F.lit("₹"), money(x / 7)),
                                         money(x * 3), money(x - 30000)))
           .when(style == 2, F.concat_ws(",", name, q, money(x), money(x / 7)))
           .when(style == 3, F.concat_ws(",", name, q, F.lit("text"), q, F.lit("extra"), q))
           .otherwise(F.concat_ws(",", name, q, F.lit("bad-number"), money(x), F.lit("NSE"))))
    data = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("file_id"),
                    (1000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), row.alias("line")))
    return frame.unionByName(data)
