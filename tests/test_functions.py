import random
import statistics

import pytest
from pyspark.sql import functions as F

from foliospark.functions import classify as C
from foliospark.functions import lookups as L
from foliospark.functions import quantiles as Q
from foliospark.functions import ratings as R
from foliospark.functions import skew
from foliospark.functions import text as T


def one(spark, column, *values, types="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {types}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_clean_numeric(spark):
    values = ["1,234.56", "₹1,234.56", "1234", "", None, "-1,234.56", "(1234.56)", "  1234  ", "12%", "abc", "--5"]
    assert one(spark, T.clean_numeric, *values) == [1234.56, 1234.56, 1234.0, 0.0, 0.0, -1234.56, -1234.56, 1234.0, 12.0, 0.0, 0.0]


def test_safe_float(spark):
    values = ["€1,2 34.5", "£'7'", "(5)", "x(5)", "12%", "nan", "5d", "Infinity", "1e3", None]
    assert one(spark, T.safe_float, *values) == [1234.5, 7.0, -5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, 0.0]
    assert one(spark, lambda c: T.safe_float(c, None), "", "nan", "3") == [None, None, 3.0]


def test_stars_and_multiplier(spark):
    scores = [90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 20.0, 10.0]
    assert one(spark, R.star_rating, *scores, types="double") == [5, 5, 4, 4, 3, 3, 2, 2, 1]
    m = one(spark, R.esg_risk_multiplier, *scores, types="double")
    assert m == sorted(m) and m[0] == 0.8 and m[-1] == 1.3


def test_risk_levels_differ_on_cut_points(spark):
    assert one(spark, R.stress_risk_level, 0.08, 0.0801, 0.15, 0.25, 0.26, types="double") == ["Low", "Medium", "Medium", "High", "Extreme"]
    assert one(spark, R.gauge_risk_level, -8.0, 15.0, -25.0, 7.9, types="double") == ["Medium Risk", "High Risk", "Extreme Risk", "Low Risk"]


def test_round_half_up(spark):
    assert one(spark, lambda c: R.round_half_up(c, 2), 2.675, -2.675, 1.005, 0.1 + 0.2, 0.0, types="double") == [2.68, -2.68, 1.01, 0.3, 0.0]


def test_sectors(spark):
    names = ["Tata Motors Ltd", "HDFC Bank", "Zee Entertainment", "Acme Widgets", "coal india", "Bank"]
    assert one(spark, C.infer_sector, *names) == ["Automobiles", "Banking", "Media & Entertainment", "Other", "Power", "Banking"]


def test_ticker_containment_rule_and_whole_words(spark):
    assert one(spark, lambda c: C.normalize_ticker(c, strict=False), "Foo Widgets LTD") == ["LT.NS"]
    assert one(spark, C.normalize_ticker, "Foo Widgets LTD", "RELIANCEEQ.NS", "NTPC LTD", "abcEQ") == [
        "FOOWIDGETSLTD.NS", "RELIANCE.NS", "NTPC.NS", "ABC.NS"]


def test_two_ticker_tables_disagree(spark):
    assert one(spark, C.normalize_ticker, "Choice International") == ["CHOICE.NS"]
    assert one(spark, C.ticker_from_name, "Choice International") == ["CHOICEIN.NS"]


def test_lookup_tables_are_small():
    for name, (_, rows) in L.TABLES.items():
        assert len(rows) < 250, name
    assert len(L.TABLES["scenario_impact"][1]) == 95


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_attach_gives_the_same_with_hot_keys(spark, hot_rows):
    rows = [("big", i) for i in range(500)] + [("b", 1), ("b", 2), ("c", 3), (None, 4)]
    df = spark.createDataFrame(rows, "k string, x int")
    s = df.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("total"))
    got = skew.attach(df, s, ["k"], ["x"], hot_rows=hot_rows)
    want = {"big": sum(range(500)), "b": 3, "c": 3, None: 4}
    out = got.collect()
    assert got.columns == ["k", "x", "total"] and len(out) == len(rows)
    assert all(r["total"] == want[r["k"]] for r in out)


def test_attach_spreads_a_hot_key(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("x"))
    s = df.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("total"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = skew.attach(df, s, ["k"], ["x"], hot_rows=100).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("p").count().collect()]
        assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_map_distinct(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["HDFC Bank"] * 20 + ["Infosys", None])], "i int, n string")
    got = {r["i"]: r["s"] for r in skew.map_distinct(df, "n", "s", C.infer_sector, ["i"], hot_rows=5).collect()}
    assert got[0] == "Banking" and got[20] == "IT Services" and len(got) == 22


@pytest.mark.parametrize("case", ["uniform", "skewed", "ties", "two_values", "signs"])
def test_exact_medians_by_refinement(spark, case):
    rnd = random.Random(7)
    make = {"uniform": lambda: rnd.random(), "skewed": lambda: 10 ** rnd.uniform(0, 12), "ties": lambda: float(rnd.choice([1, 1, 1, 1, 2, 3])),
            "two_values": lambda: rnd.choice([0.0, 1e9]), "signs": lambda: rnd.gauss(0, 1e6)}[case]
    rows = [("a", make()) for _ in range(701)] + [("b", make()) for _ in range(300)] + [("c", 5.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["median"] for r in Q.exact_medians(df, ["g"], ["x"], small_group=20, bins=8).collect()}
    want = {g: statistics.median([x for k, x in rows if k == g and x is not None]) for g in "abc"}
    assert got == pytest.approx(want, rel=1e-15)


def test_request_routing(spark):
    texts = ["Run a stress test of my portfolio in a recession", "loan approval for this applicant", "hello", "market risk of loan credit borrower"]
    assert one(spark, C.route_request, *texts) == ["stress", "credit", "credit", "credit"]


def test_tickers_written_out(spark):
    names = {
        "Reliance Industries": "RELIANCE.NS", "RELIND": "RELIANCE.NS", "Tata Consultancy Services": "TCS.NS", "Hdfc Bank": "HDFCBANK.NS",
        "Infosys": "INFY.NS", "State Bank": "SBIN.NS", "HUL": "HINDUNILVR.NS", "L&T": "LT.NS", "Larsen": "LT.NS", "M&M": "M&M.NS",
        "Bajaj Auto": "BAJAJ-AUTO.NS", "Vedanta": "VEDL.NS", "SESGOA": "VEDL.NS", "TATIRO": "TATASTEEL.NS", "BPCLTD": "BPCL.NS",
        "Bharat Petroleum": "BPCL.NS", "Indian Oil": "IOC.NS", "Oil and Natural Gas": "ONGC.NS", "Central Depository": "CDSL.NS",
        "Satin Creditcare Network": "SATIN.NS", "SATINVEQ": "SATIN.NS", "EMCUREEQ": "EMCURE.NS", "GANDHAREQ": "GANDHAR.NS",
        "SHRIRAMPP": "SHRIRAMPP.NS", "Gandhar Oil Refinery (India) Limited": "GANDHAR.NS",
        "Central Depository Services (India) Ltd": "CDSL.NS", "Bharat Petroleum Corp Lt": "BPCL.NS", "Reliance Industries Ltd": "RELIANCE.NS"}
    assert dict(zip(names, one(spark, C.normalize_ticker, *names))) == names
    # names that no entry holds fall back to themselves
    assert one(spark, C.normalize_ticker, "Castrol Oil", "Hindustan Oil Exploration", "Acme") == ["CASTROLOIL.NS", "HINDUSTANOILEXPLORATION.NS", "ACME.NS"]
    # as plain containment the first entry in order wins, so LT is found in a longer name
    assert one(spark, lambda c: C.normalize_ticker(c, strict=False), "Tata Motors Ltd", "Castrol Oil") == ["LT.NS", "CASTROLOIL.NS"]
    assert len(L.TICKER_NAMES) == len(dict(L.TICKER_NAMES)) == 229


def test_rows_without_a_key_are_a_group(spark):
    from foliospark.functions import skew
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), (None, 5)], "k string, v int")
    totals = rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.sum("v").alias("t"))
    for hot in (1, 2, 100):  # joined as hot and as ordinary groups
        assert sorted(r["t"] for r in skew.attach(rows, totals, ["k"], ["v"], hot_rows=hot).collect()) == [3, 3, 12, 12, 12]
    named = skew.map_distinct(rows, "k", "out", lambda c: F.coalesce(c, F.lit("none")), ["v"])
    assert sorted(r["out"] for r in named.collect()) == ["a", "a", "none", "none", "none"]
