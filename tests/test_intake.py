import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliospark.operators import intake as N
from foliospark.sources import readers

FILE_A = """Stock Name,ISIN,Quantity,Average buy price,Buy value,Closing price,Closing value
HDFC Bank,INE040A01034,10,1500,15000,1600,16000
Infosys,INE009A01021,5,1400,7000,(1500),7500
ITC Ltd,INE154A01025,100,"200",20000,210%,21000
"""
FILE_B = """﻿Client,ABC
Report generated on,2024

Symbol,ISIN,Qty,Avg. Cost,LTP,Current Value,P&L
HDFCBANK,INE040A01034,10,1500,"1600",16000,1000
INFY,INE009A01021,5,1400,1500,7500,500
"""
FILE_C = """Company Name,Shares,Buy Price,Current Price,Total Value
Adani Total Gas,10,100,110,1100
Wipro,20,400,410,8200
Total,,,,9300
"""
REPORT = """Client,X
Realised trades,,
Stock Name,Quantity,Buy Value
Old Co,1,100
Unrealised trades (Holdings as on 2024-01-31),,
Stock Name,Quantity,Buy Value,Closing Value
New Co,2,200,250
N/A,2,200,250
Summary,,,
"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("broker")
    texts = {"a.csv": FILE_A, "b.csv": FILE_B.replace("\n", "\r\n"), "c.csv": FILE_C, "r.csv": REPORT, "short.csv": "one line\n", "none.csv": "x\ny\nz\n"}
    for name, text in texts.items():
        (d / name).write_bytes(text.encode())
    return N.BrokerFiles(readers.read_broker_lines(spark, str(d)))


def by_file(df, *cols):
    return {r["file_id"].rsplit("/", 1)[1]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_status_and_broker(files):
    assert by_file(files.headers, "status") == {
        "a.csv": "ok", "b.csv": "ok", "c.csv": "ok", "r.csv": "ok", "short.csv": "too short", "none.csv": "no header"}
    assert by_file(files.mapping, "broker")["c.csv"] == "Generic"
    head = by_file(files.mapping, "header")
    assert head["b.csv"][0] == "Symbol" and head["r.csv"][-1] == "Closing Value"


def test_rows(files):
    rows = {(r["file_id"].rsplit("/", 1)[1], r["stock_name"]): r for r in files.rows.collect()}
    assert len([k for k in rows if k[0] == "a.csv"]) == 3
    assert rows["a.csv", "Infosys"]["current_price"] == -1500.0
    assert rows["a.csv", "ITC Ltd"]["current_price"] == 210.0
    assert rows["b.csv", "INFY"]["pnl"] == 500.0 and rows["b.csv", "INFY"]["avg_price"] is None
    assert [k[1] for k in rows if k[0] == "r.csv"] == ["New Co"]
    # a company with Total inside its name stays, the total line goes
    assert sorted(k[1] for k in rows if k[0] == "c.csv") == ["Adani Total Gas", "Wipro"]


def test_faithful_total_rule_drops_company(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(FILE_C.strip().split("\n"))], "file_id string, pos bigint, line string")
    names = [r["stock_name"] for r in N.BrokerFiles(lines, strict_totals=False).rows.collect()]
    assert names == ["Wipro"]


def test_hot_file_gives_the_same(spark):
    body = "Stock Name,Qty,Current Price\n" + "\n".join(f"S{i},{i},2" for i in range(1, 300))
    lines = [("big", i, x) for i, x in enumerate(body.split("\n"))] + [("f", i, x) for i, x in enumerate(FILE_C.strip().split("\n"))]
    df = spark.createDataFrame(lines, "file_id string, pos bigint, line string")
    count = lambda hot: {r["file_id"]: r["count"] for r in N.BrokerFiles(df, hot_rows=hot).rows.groupBy("file_id").count().collect()}
    assert count(5) == count(10_000) == {"big": 299, "f": 2}


def test_line_positions_across_splits(spark, tmp_path):
    text = "\n".join(f"{i:06d}," + "x" * (i % 40) for i in range(5000)) + "\n"
    (tmp_path / "f.csv").write_text(text)
    (tmp_path / "g.csv").write_text("\n" * 300 + "end\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_broker_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = [r["line"] for r in df.filter(F.col("file_id").endswith("f.csv")).orderBy("pos").collect()]
        assert got == text.strip().split("\n")
        assert df.select("file_id", "pos").distinct().count() == df.count() == 5301
        assert df.filter(F.col("file_id").endswith("g.csv")).orderBy(F.desc("pos")).first()["line"] == "end"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def holdings(spark, *rows):
    cols = "portfolio_id int, holding_id string, stock_name string, quantity double, prev_close double, current_price double, current_value double, invested_value double, pnl double, avg_price double"
    return spark.createDataFrame([(1, str(i), *r) for i, r in enumerate(rows)], cols)


def test_repairs_in_order(spark):
    h = holdings(spark,
                 ("A", 10.0, 5.0, None, None, None, 10.0, None),     # previous close, value, invested, prices
                 ("B", 2.0, None, None, None, 100.0, 20.0, None),    # value from invested + pnl
                 ("C", 0.0, 5.0, None, None, None, 1.0, None),       # no quantity: nothing to repair, dropped
                 (None, 1.0, None, 1.0, 1.0, 1.0, 0.0, 1.0), ("  ", 1.0, None, 1.0, 1.0, 1.0, 0.0, 1.0))
    out = {r["stock_name"]: r for r in N.clean(h).collect()}
    assert sorted(out) == ["A", "B"]
    a, b = out["A"], out["B"]
    assert (a["current_price"], a["current_value"], a["invested_value"], a["avg_price"]) == (5.0, 50.0, 40.0, 4.0)
    assert (b["current_value"], b["current_price"], b["avg_price"]) == (120.0, 60.0, 50.0)
    counts = {r["category"]: r["changes"] for r in N.audit_counts(N.cleaning_audit(h)).collect()}
    assert counts["Removed Rows (Missing Stock Name)"] == 2 and counts["Rows Removed (Insufficient Data)"] == 1
    assert counts["Calculated Missing Sell Prices"] == 3 and counts["Calculated Missing Buy Prices"] == 2


def test_date_headers():
    cols = ["Name", "2024-01-05", "05-02-2024", "Mar 01, 2024", "Prev Close", "Previous Price", "Price"]
    assert N.date_price_columns(cols) == [
        ("Mar 01, 2024", dt.date(2024, 3, 1)), ("05-02-2024", dt.date(2024, 2, 5)), ("2024-01-05", dt.date(2024, 1, 5)),
        ("Prev Close", None), ("Previous Price", None)]


def test_resolve_columns_prefers_exact_aliases():
    roles = N.resolve_columns(["Stock Name", "ISIN", "Quantity", "Average buy price", "Buy value", "Closing price", "Closing value"])
    assert roles["current_price"] == "Closing price" and roles["current_value"] == "Closing value" and roles["invested_value"] == "Buy value"


def test_value_methods(spark):
    cols = "portfolio_id int, current_value double, quantity double, current_price double, date_price double, invested_value double, pnl double, change_pct double, avg_price double"
    rows = [(1, 5.0, 1.0, 1.0, None, None, None, None, None), (2, 0.0, 2.0, 3.0, None, None, None, None, None), (3, None, 2.0, None, 4.0, None, None, None, None),
            (4, None, None, None, 4.0, 10.0, None, None, 5.0), (5, None, None, None, None, 10.0, -3.0, None, None), (6, None, None, None, None, 10.0, None, 5.0, None),
            (7, None, 2.0, None, None, None, None, 0.5, 4.0), (8, None, 2.0, None, None, None, None, None, 4.0), (9, None, None, None, None, 7.0, None, None, None),
            (10, None, None, None, None, None, None, None, None)]
    got = {r["portfolio_id"]: (r["value"], r["value_method"]) for r in N.value_holding(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (5.0, "direct_current_value"), 2: (6.0, "qty_x_price"), 3: (8.0, "qty_x_date_price"), 4: (8.0, "estimated_qty_x_date_price"),
                   5: (7.0, "invested_plus_pnl"), 6: (10.5, "invested_x_change_pct"), 7: (12.0, "qty_x_avg_cost_with_change"), 8: (8.0, "qty_x_avg_cost"),
                   9: (7.0, "invested_fallback"), 10: (0.0, "no_calculation_possible")}


def test_profit_header_spellings(spark):
    from foliospark.operators import intake as I
    for header in ["P&L", "pnl", "Profit Loss", "gain loss", "Profit/Loss", "Unrealized P&L", "Unrealized Profit/Loss", "Unrealized Profit / Loss",
                   "Unrealised Profit/Loss", "Unrealised P&L", "Realized Profit/Loss", "Realised Profit/Loss", "Profit & Loss", "gain/loss", "Profit / Loss"]:
        assert I.find_column(["Name", header, "Qty"], I.ROLE_PATTERNS["pnl"]) == header


def test_first_section_without_preferred_holdings(spark):
    from foliospark.operators import intake as I
    facts = spark.createDataFrame([("f", 0, "realised", 1), ("f", 5, None, 3), ("f", 9, "realised", 1), ("f", 12, None, 3)], "file_id string, pos bigint, section string, commas int")
    assert [I.find_sections(facts, p).first()["start"] for p in (True, False)] == [9, 0]
