import datetime
import json
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import lookups as L
from foliospark.operators import credit as K
from foliospark.operators import esg as E
from foliospark.operators import features as X
from foliospark.operators import market as M
from foliospark.operators import model as ML
from foliospark.operators import portfolio as P
from foliospark.operators import stress as S

# the five-row sample portfolio: total value 4,795,000
SAMPLE = [("RELIANCE.NS", 100, 2450.0, "Oil & Gas"), ("TCS.NS", 500, 3400.0, "IT Services"), ("HDFCBANK.NS", 1000, 1650.0, "Banking"),
          ("ITC.NS", 2000, 450.0, "FMCG"), ("INFY.NS", 200, 1500.0, "IT Services")]


def holdings(spark, rows=SAMPLE, pid=1):
    data = [(pid, f"{pid}-{i}", i, n, s, float(q), p, p * 0.9, q * p * 0.9, q * p) for i, (n, q, p, s) in enumerate(rows)]
    return spark.createDataFrame(data, "portfolio_id int, holding_id string, security_id int, stock_name string, sector string, quantity double, "
                                       "price double, avg_cost double, invested double, value double")


def test_total_and_single_sector_hhi(spark):
    h = holdings(spark)
    assert P.portfolio_summary(h).first()["total_value"] == 4_795_000.0
    one = holdings(spark, [(n, q, p, "Banking") for n, q, p, _ in SAMPLE])
    d = S.diversification(S.sector_composition(one)).first()
    assert d["hhi"] == 10000.0 and d["diversification_factor"] == 0.0


def test_stress_by_hand(spark):
    h = holdings(spark)
    r = {x["scenario_key"]: x for x in S.stress(h).collect()}
    tot = sum(q * p for _, q, p, _ in SAMPLE)
    w = {}
    for _, q, p, s in SAMPLE:
        w[s] = w.get(s, 0) + q * p / tot
    beta = dict(L.SECTOR_BETA)
    base = dict(zip(L.MATRIX_SECTORS, L.SCENARIO_IMPACT["tech_sector_crash"]))
    b = sum(v * base[s] * beta[s] for s, v in w.items())
    factor = round(1 - sum(v * v for v in w.values()), 4)
    assert r["tech_sector_crash"]["impact_percentage"] == pytest.approx(b * (1 + (1 - factor) * 0.2), abs=1e-4)
    assert set(r) == set(L.SCENARIO_IMPACT)


def test_unknown_sector_counts_as_other_and_empty_portfolio(spark):
    h = holdings(spark, [("X", 1, 100.0, "Media & Entertainment")])
    c = S.scenario_contributions(S.sector_composition(h)).filter("scenario_key = 'market_correction'").first()
    assert c["baseline_pct"] == -10.0 and c["beta"] == 1.0
    assert S.stress(h.limit(0)).count() == 0


def test_custom_scenario_grid(spark):
    grid = S.scenario_grid(spark, {"mine": {"Banking": -50.0, "Other": -1.0}})
    h = holdings(spark)
    out = S.scenario_contributions(S.sector_composition(h), grid, ["Banking", "Other"]).collect()
    assert {r["sector"]: r["baseline_pct"] for r in out} == {"Banking": -50.0, "Oil & Gas": -1.0, "IT Services": -1.0, "FMCG": -1.0}


def test_floor_and_fallback_scenario(spark):
    comp = spark.createDataFrame([(1, "a", 100.0, 10.0)], "portfolio_id int, sector string, weight_pct double, portfolio_value double")
    grid = S.scenario_grid(spark, {"tiny": {"a": -0.1}, "zero": {"a": 0.0}})
    r = {x["scenario_key"]: x for x in S.scenario_impact(S.scenario_contributions(comp, grid, ["a"])).collect()}
    assert r["tiny"]["final_impact"] == -0.25 and r["tiny"]["floor_applied"]
    assert r["zero"]["final_impact"] == 0.0 and r["zero"]["warning"] == "insufficient_contributions"
    req = spark.createDataFrame([("credit_crisis",), ("inflation_spike",)], "scenario_key string")
    got = {x["scenario_key"]: (x["used_key"], x["is_fallback"]) for x in S.get_scenarios(req).collect()}
    assert got == {"credit_crisis": ("market_correction", True), "inflation_spike": ("inflation_spike", False)}


def test_weights_with_a_hot_portfolio(spark):
    rows = [(f"n{i}", 1, float(i + 1), "Banking") for i in range(200)]
    h = holdings(spark, rows, 1).unionByName(holdings(spark, SAMPLE, 2))
    for hot in (10, 10_000):
        got = P.weights(h, hot_rows=hot).groupBy("portfolio_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
        assert {r["portfolio_id"]: r["n"] for r in got} == {1: 200, 2: 5}
        assert all(r["w"] == pytest.approx(1.0) for r in got)


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = P.top_holdings(holdings(spark).repartition(3), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_esg_tiers_and_proxy(spark):
    sec = spark.createDataFrame([(0, 10, None), (1, 11, 6e10), (2, 12, 6e10), (3, 13, 1e9), (4, 14, 6e9)], "security_id int, ticker int, market_cap double")
    snap = spark.createDataFrame([(10, 90.0, 90.0, 90.0)], "ticker int, e double, s double, g double")
    comp = spark.createDataFrame([(10, 1.0, 1.0, 1.0), (11, 40.0, 60.0, 80.0)], "ticker int, e double, s double, g double")
    pred = spark.createDataFrame([(2, 66.0, 0.1, None, None, None), (3, 70.0, 0.9, None, None, None)],
                                 "security_id int, predicted double, imputation_ratio double, m_e double, m_s double, m_g double")
    s = {r["security_id"]: r for r in E.score_holdings(holdings(spark), E.resolve_esg_tier(sec, snap, comp, pred)).collect()}
    assert [s[i]["tier"] for i in range(5)] == ["api", "company", "model", "proxy", "proxy"]
    assert s[0]["overall"] == 90.0 and s[0]["stars"] == 5
    assert s[1]["overall"] == pytest.approx(0.3 * 40 + 0.4 * 60 + 0.3 * 80)
    assert s[2]["overall"] == 66.0                      # a model score without pillars stands by itself
    assert s[3]["overall"] == pytest.approx((60 + 65 + 65) / 3 * 0.9, abs=0.01)   # small cap
    assert s[4]["overall"] == pytest.approx((70 + 65 + 70) / 3, abs=0.01)


def test_unrated_portfolio(spark):
    esg = spark.createDataFrame([], "portfolio_id int, env double, social double, gov double, overall double, stars int, label string, "
                                    "risk_level string, risk_multiplier double, total_holdings bigint, total_value double")
    r = E.portfolio_profile(spark.createDataFrame([(7,)], "portfolio_id int"), esg).first()
    assert (r["stars"], r["label"], r["risk_multiplier"], r["total_holdings"]) == (0, "No Data", 1.0, 0)


def test_price_features_edges(spark):
    def series(n, sym):
        return [(sym, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", 100.0 + i * (1 + i % 3)) for i in range(n)]
    df = spark.createDataFrame(series(1, "one") + series(20, "short") + series(30, "thirty") + series(31, "more"), "symbol string, d string, close double")
    f = {r["symbol"]: r for r in M.price_features(df.selectExpr("symbol", "cast(d as date) dt", "close")).collect()}
    assert f["one"]["vol_30d"] is None and f["one"]["ret_1m"] is None
    assert f["thirty"]["vol_30d"] is None          # 30 closes are 29 returns
    assert f["more"]["vol_30d"] > 0 and f["short"]["vol_30d"] > 0
    closes = [100.0 + i * (1 + i % 3) for i in range(31)]
    assert f["more"]["ret_1m"] == pytest.approx(closes[30] / closes[9] - 1)


def test_split_is_stable_and_credit_scores(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in X.split_rows(df, "k").collect()}
    b = {r["k"]: r["split"] for r in X.split_rows(df.repartition(7), "k").collect()}
    assert a == b and 0.65 < sum(v == "train" for v in a.values()) / 3000 < 0.75
    row = (1, 75000.0, 5, 0.35, 0.45, 1, 84, 50000.0)
    app = spark.createDataFrame([row], "applicant_id int, income double, employment_years int, debt_to_income double, credit_utilization double, "
                                       "late_payments_last_2y int, credit_history_months int, existing_debt double")
    r = K.credit_decision(K.credit_score(app)).first()
    assert (r["risk_score"], r["decision"]) == (35, "CONDITIONAL APPROVAL")
    assert [x["factor"] for x in K.reason_codes(app).orderBy("ord").collect()] == [
        "Recent Late Payments", "Strong Income", "Stable Employment", "Established Credit History"]


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.range(600).selectExpr("id AS symbol", "(id * 37 % 101) / 10.0D AS a", "(id * 53 % 97) / 10.0D AS b", "1.0D AS weight",
                                     "if(id % 10 < 3, 'A', 'B') AS sector", "false AS imputed")
    df = X.split_rows(df.withColumn("total_esg", F.expr("20 + 3 * a + 2 * b")), "symbol")
    return df, ML.train_esg(df, ["a", "b"], rounds=20, leaves=16, step=0.3)


def test_model_beats_sector_baseline(spark, trained):
    df, model = trained
    y = X.sector_mean_baseline(ML.predict_esg(df, model, ["a", "b"]))
    r = {x["split"]: x for x in X.model_vs_baseline(y, "total_esg", "prediction", "y_proxy").collect()}
    assert r["test"]["mae_gain"] > 0 and r["test"]["rmse_gain"] > 0


def test_training_continues_and_stops_by_patience():
    from foliospark.operators import boosting as B
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, (600, 3)).astype(float)
    cuts, val, ones = [np.arange(49.0)] * 3, np.arange(600) % 5 == 0, np.ones(600)
    grown, plain = [], B.grow
    for y, patience in ((x @ [1.0, 2.0, 0.0], 200), (rng.normal(size=600), 4)):
        grown.clear()
        B.grow = lambda *a: grown.append(1) or plain(*a)
        try:
            base, trees = B.boost(x, y, ones, val, cuts, 120, 0.1, patience, 8, 20)
        finally:
            B.grow = plain
        again = B.boost(x, y, ones, val, cuts, len(trees), 0.1, patience, 8, 20)
        assert again == (base, trees)  # a shorter training is the beginning of a longer one
        assert len(grown) == (120 if patience == 200 else len(trees) + patience)  # every round grows one tree, up to patience after the best
    assert len(trees) < 40  # nothing to learn


def boosted(leaves=8, rounds=6):
    from foliospark.operators import boosting as B
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, (900, 4)).astype(float)
    y = x[:, 0] + np.where(x[:, 1] > 20, x[:, 2], 0) + rng.normal(size=900)
    cuts = [np.arange(39.0)] * 4
    base, trees = B.boost(x, y, np.ones(900), np.zeros(900, bool), cuts, rounds, 0.3, 5, leaves, 20)
    rows = [(t, i, n[0], float(cuts[n[0]][n[1]]) if n[0] >= 0 else 0.0, *n[2:]) for t, nodes in enumerate(trees) for i, n in enumerate(nodes)]
    return B.from_nodes(pd.DataFrame(rows, columns=[c.split()[0] for c in B.NODE_SCHEMA.split(", ")]), list("abcd"), base), x, y


def test_tree_attributions_equal_all_subsets():
    model, x, y = boosted()
    def known(t, i, row, s):
        f = model.feature[t, i]
        if f < 0:
            return model.value[t, i]
        low, high = model.lower[t, i], model.upper[t, i]
        if f in s:
            return known(t, low if row[f] <= model.threshold[t, i] else high, row, s)
        return (model.cover[t, low] * known(t, low, row, s) + model.cover[t, high] * known(t, high, row, s)) / model.cover[t, i]
    value = lambda row, s: model.base + sum(known(t, 0, row, s) for t in range(model.trees))
    rows = np.concatenate([x[:4], [[np.nan, 3.0, 50.0, -1.0]]])
    found = model.attributions(rows)
    for row, parts in zip(rows, found, strict=True):
        for j in range(4):
            rest = [i for i in range(4) if i != j]
            want = sum(math.factorial(n) * math.factorial(3 - n) / 24 * (value(row, {*s, j}) - value(row, set(s))) for n in range(4) for s in combinations(rest, n))
            assert parts[j] == pytest.approx(want, abs=1e-9)
    assert found.sum(axis=1) == pytest.approx(model.predict(rows) - model.expected(), abs=1e-9)
    assert np.mean((model.predict(x) - y) ** 2) < 0.2 * np.var(y) and sum(model.importance().values()) == pytest.approx(1.0)


def test_stored_model_is_trained_once(spark, monkeypatch):
    from pyspark.sql import Row
    rows = spark.createDataFrame([Row(symbol=i, a=float(i % 17), b=float(i % 23) if i % 9 else None, sector=[None, "x", "y & z"][i % 3], weight=1.0,
                                      total_esg=40.0 + i % 17 + 5 * (i % 3), split=["train", "train", "val", "test"][i % 4]) for i in range(400)])
    first = ML.stored_model(rows, ["a", "b"], "sector", rounds=30)
    monkeypatch.setattr(ML, "train_model", None)  # training again would fail
    again = ML.stored_model(rows.repartition(5), ["a", "b"], "sector", rounds=30)
    assert again.cols == first.cols == ["a", "b", f"sector_{X.UNKNOWN}", "sector_x", "sector_y & z"]
    score = lambda m: sorted(tuple(r) for r in m.predict(rows).select("symbol", "prediction").collect())
    assert score(again) == score(first) and len(set(p for _, p in score(first))) > 20
    with pytest.raises(TypeError):
        ML.stored_model(rows.where("symbol <> 7"), ["a", "b"], "sector", rounds=30)  # other rows, another model
    parts = again.trees.explain(again.prepare(rows), "symbol").groupBy("symbol").agg(F.sum("attribution").alias("s"), F.count("*").alias("n"))
    for r in again.trees.score(again.prepare(rows)).join(parts, "symbol").collect():
        assert r["n"] == 5 and r["s"] + again.trees.expected() == pytest.approx(r["prediction"], abs=1e-9)


def test_sampled_attributions_add_up(spark, trained):
    df, model = trained
    rows = df.limit(5)
    back = df.filter("symbol = 77")
    attr = ML.shapley_sampled(rows, "symbol", model, ["a", "b"], back, permutations=6)
    sums = {r["symbol"]: r["s"] for r in attr.groupBy("symbol").agg(F.sum("attribution").alias("s")).collect()}
    f = lambda d: {r["symbol"]: r["prediction"] for r in model.transform(ML.assemble(d, ["a", "b"])).collect()}
    fb = f(back)[77]
    assert len(sums) == 5
    for k, v in f(rows).items():
        assert sums[k] == pytest.approx(v - fb, abs=1e-6)


def test_linear_attributions_match_sampled_order(spark, trained):
    df, _ = trained
    means = ML.column_means(df, ["a", "b"])
    attr = ML.shapley_linear(df.limit(3), "symbol", {"a": 3.0, "b": 2.0}, means)
    tot = {r["symbol"]: r["s"] for r in attr.groupBy("symbol").agg(F.sum("attribution").alias("s")).collect()}
    base = 20 + 3 * means["a"] + 2 * means["b"]
    for r in df.limit(3).collect():
        assert tot[r["symbol"]] == pytest.approx(r["total_esg"] - base)


def test_local_surrogate_signs(spark, trained):
    df, model = trained
    w = ML.local_surrogate(df.filter("a > 2 and b > 2").limit(4), "symbol", model, ["a", "b"], samples=150, top=2).collect()
    assert len(w) == 8 and all(r["weight"] > -0.5 for r in w) and sum(r["weight"] for r in w) > 0


def test_weighted_ridge_equals_plain_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=5).tolist(), float(rng.normal() * 10), float(rng.random())) for k in (1, 2, None) for _ in range(40)]
    df = spark.createDataFrame([*rows, (1, [9.0] * 5, None, 1.0), (7, [1.0] * 5, 3.0, 0.0)], "k int, x array<double>, y double, w double").repartition(5)
    fitted = ML.weighted_ridge(df, "k", "x", "y", "w", 5)
    assert "Pandas" not in fitted._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["beta"] for r in fitted.collect()}
    assert set(got) == {1, 2, None, 7} and got[7] is None
    for k in (1, 2, None):
        x, y, w = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2, 3))
        xc, yc = x - w @ x / w.sum(), y - w @ y / w.sum()
        want = np.linalg.solve(xc.T @ (xc * w[:, None]) + np.eye(5), xc.T @ (yc * w))
        assert got[k] == pytest.approx(want.tolist(), abs=1e-9)
    assert ML.weighted_ridge(df.limit(0), "k", "x", "y", "w", 5).count() == 0


def test_encoders_and_detection(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", 3.0)], "sector string, x double")
    enc = X.EncodeCategories().fit(df, "sector")
    new = spark.createDataFrame([("zzz", 1.0), ("a", 1.0)], "sector string, x double")
    got = X.align_dummies(new, [enc], ["sector_a", "sector_b", "sector_gone", "x"]).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 1.0), (1, 0, 0, 1.0)]
    assert X.target_column(["a", "label", "z"]) == "label" and X.target_column(["a", "z"]) == "z"


def test_many_categories_are_joined(spark):
    train = spark.range(300_000).select((F.col("id") % 250_000).cast("string").alias("c"), F.lit(1.0).alias("x"))
    enc = X.CategoryIndex().fit(train.union(spark.createDataFrame([(None, 0.0)], "c string, x double")), "c")
    order = sorted([str(i) for i in range(250_000)] + [X.UNKNOWN])
    assert enc.size == len(order)
    new = spark.createDataFrame([("7", 2.0), (None, 0.0), ("new", None), ("249999", 1.0), ("7", 3.0)], "c string, x double")
    got = X.align_sparse(new, [enc], ["x", "gone"], "v", ["x"])
    want = sorted((c, x, ([0] if x else []) + ([order.index(c or X.UNKNOWN) + 2] if c != "new" else [])) for c, x in [("7", 2.0), ("", 0.0), ("new", 0.0), ("249999", 1.0), ("7", 3.0)])
    assert sorted((r.c or "", r.x or 0.0, r.v["indices"]) for r in got.collect()) == want
    assert {r.v["size"] for r in got.collect()} == {250_003} and len(got.columns) == 3
    assert X.CategoryIndex().fit(train.limit(0), "c").transform(new, "v", ["x"]).filter("size(v.indices) > 0").count() == 0


def test_company_documents_are_cut_into_entries(spark, tmp_path):
    from foliospark.sources import readers
    docs = {
        "plain": {f"t{i}": {"E": i, "S": i + 0.5, "tier": 'Go"od, [x]'} for i in range(50)} | {"_about": {"E": 1}},
        "indented name": {"ab": {"E": 1.0, "G": None}, "quo\\te": {"total": 9}},
        "inner": {"in1": {"E": 3, "more": {"S": 1}}, "in2": {"S": 4}},
        "brace": {"br}1": {"E": 5, "tier": "a}, {b"}, "br2": {"E": 6}},
        "empty": {}, "none": {"n1": {}},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2 if " " in name else None) + "\n", encoding="utf-8")
    want = sorted((k.upper(), v.get("E", 50.0), v.get("S", 50.0), v.get("tier", "Average")) for d in docs.values() for k, v in d.items() if not k.startswith("_"))
    assert sorted((r.ticker, r.e, r.s, r.tier) for r in readers.read_company_esg(spark, str(tmp_path)).collect()) == want
    # one document of many splits
    big = tmp_path / "big"
    big.mkdir()
    (big / "one.json").write_text(json.dumps({f"k{i}": {"E": i % 100, "tier": "x" * 20} for i in range(60_000)}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        df = readers.read_company_esg(spark, str(big))
        assert df.rdd.getNumPartitions() > 8
        assert df.count() == 60_000 and df.select("ticker").distinct().count() == 60_000 and df.agg(F.sum("e")).first()[0] == 600 * 4950
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_compacted_snapshots(spark, tmp_path):
    from foliospark.operators.market import latest_snapshot
    from foliospark.sources.snapshots import SnapshotStore
    store, history = SnapshotStore(spark, str(tmp_path / "store"), buckets=8), []
    with pytest.raises(FileNotFoundError):
        store.latest()

    def land(rows):
        history.extend(rows)
        store.append(spark.createDataFrame(rows, "ticker string, provider string, fact_id long, fetch_ts timestamp_ntz, e double, s double, g double, overall double"))

    def same():
        want = latest_snapshot(spark.createDataFrame(history, "ticker string, provider string, fact_id long, fetch_ts timestamp_ntz, e double, s double, g double, overall double"))
        got = store.latest()
        assert sorted((str(r.ticker), r.provider, r.fact_id) for r in got.collect()) == sorted((str(r.ticker), r.provider, r.fact_id) for r in want.collect())
        return got
    day = lambda n: datetime.datetime(2024, 1, n)
    land([(f"t{i % 30}", "p", i, day(1 + i % 5), 1.0, None, 2.0, 3.0) for i in range(200)])
    land([(None, "p", 900, day(2), 1.0, 1.0, 1.0, 1.0), ("t1", "a", 901, day(5), 1.0, 1.0, 1.0, 1.0)])
    same()
    assert store.compact() == 2 and store.compact() == 0
    assert all("/landed/" not in f for f in same().inputFiles())
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "current").glob("bucket=*/*.parquet")}
    land([("t3", "p", 902, day(9), 1.0, 1.0, 1.0, 1.0), ("t4", "p", 903, day(1), 1.0, 1.0, 1.0, 1.0)])  # newer, and older than what is there
    assert len({f.split("/landed/")[1].split("/")[0] for f in same().inputFiles() if "/landed/" in f}) == 1
    # one that dies before its mark is repeated without harm; an append without its end does not count
    (tmp_path / "store" / "landed" / "batch=0").mkdir()
    assert store.compact() == 1
    for mark in list((tmp_path / "store" / "folded").iterdir())[1:]:
        mark.rename(tmp_path / mark.name)
    assert store.compact() >= 1
    assert all("/landed/" not in f for f in same().inputFiles())
    kept = [f for f in before if f.exists()]
    assert kept and len(kept) < len(before)  # buckets without a new row were not written again


def test_buckets_that_do_not_change_are_not_written(spark, tmp_path):
    from foliospark.sources.snapshots import SnapshotStore
    store, day = SnapshotStore(spark, str(tmp_path / "store"), buckets=8), lambda n: datetime.datetime(2024, 1, n)
    rows = lambda *r: spark.createDataFrame(list(r), "ticker string, provider string, fact_id long, fetch_ts timestamp_ntz, e double, s double, g double, overall double")
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "current").glob("bucket=*/*.parquet")}
    store.append(rows(*[(f"t{i}", "p", i, day(5), 1.0, None, 2.0, 3.0) for i in range(40)]))
    assert store.compact() == 1
    first = files()
    store.append(rows(*[(f"t{i}", "p", 100 + i, day(1), 9.0, 9.0, 9.0, 9.0) for i in range(40)]))  # older
    for mark in (tmp_path / "store" / "folded").iterdir():
        mark.rename(tmp_path / mark.name)
    assert store.compact() == 2 and files() == first  # and the first once more
    store.append(rows(("t3", "p", 200, day(9), 1.0, 1.0, 1.0, 1.0)))
    assert store.compact() == 1 and len(files().keys() & first.keys()) == len(first) - 1
    assert {r.ticker: r.fact_id for r in store.latest().collect()} == {f"t{i}": 200 if i == 3 else i for i in range(40)}


def test_headers_of_many_files(spark, tmp_path):
    from foliospark.sources import readers
    for i in range(40):
        (tmp_path / f"{i}.csv").write_text(f"qty,name\n{i},n{i}\n\n" if i % 2 else f'name,"unit, price", qty\r\n"n""{i}",1.5,{i}\r\nshort\r\n')
    (tmp_path / "empty.csv").write_text("")
    df = readers.read_holdings_csv(spark, str(tmp_path), "name string, qty int, `unit, price` double")
    rows = df.collect()
    assert sorted(r.qty for r in rows if r.qty is not None) == list(range(40)) and len(rows) == 60
    assert {(r.name, r["unit, price"]) for r in rows if r.qty == 7} == {("n7", None)} and {r["unit, price"] for r in rows if r.qty == 8} == {1.5}
    assert "Union" not in df._jdf.queryExecution().analyzed().toString()
    (tmp_path / "twice.csv").write_text("qty,qty\n1,2\n")
    with pytest.raises(ValueError, match="repeats"):
        readers.read_holdings_csv(spark, str(tmp_path), "qty int")
    with pytest.raises(ValueError, match="total_esg"):
        readers.read_esg_training(spark, str(tmp_path / "1.csv"))


def test_holdings_without_a_name_keep_their_weight(spark):
    from foliospark.functions import classify as C
    h = holdings(spark, [("Infosys", 1, 100.0, "IT Services"), (None, 3, 100.0, "Other")])
    w = {r["category"]: r["wt"] for r in P.category_weights(h, C.categorize_asset).collect()}
    assert w == {"large_cap_stocks": 1.0}
    s = S.impact_scatter(h, "recession_scenario").collect()
    assert sum(r["exposure_pct"] for r in s) == pytest.approx(100.0) and {r["exposure_pct"] for r in s} == {25.0, 75.0}


def test_groups_use_all_features(spark):
    rows = [(i, f"sector_{n}" if n >= 20 else f"beta_{n}", 1.0, float(100 - n)) for i in (0, 1) for n in range(23)]
    attr = spark.createDataFrame(rows, "security_id int, feature string, value double, attribution double")
    h = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25), (1, 9, 0.25)], "portfolio_id int, security_id int, weight double")
    c = ML.portfolio_attribution(h, attr, 40.0)
    assert c.count() == 23 and {r["base"] for r in c.collect()} == {30.0} and {r["coverage_weight"] for r in c.collect()} == {0.75}
    total = 0.75 * sum(100 - n for n in range(23))
    assert {r["prediction"] for r in c.collect()} == {30.0 + total}
    g = {r["feature_group"]: r["contribution"] for r in ML.attribution_groups(c).collect()}
    assert g["Sector"] == 0.75 * (80 + 79 + 78) and sum(g.values()) == pytest.approx(total)


def test_columns_are_read_by_name(spark, tmp_path):
    from foliospark.sources import readers
    (tmp_path / "a.csv").write_text("holding,price,qty\nA,10,2\n")
    (tmp_path / "b c.csv").write_text('\ufeffqty,"holding",extra\n7,"B, Inc",x\n', encoding="utf-8")
    rows = readers.read_holdings_csv(spark, str(tmp_path), "holding string, qty int, price double").collect()
    assert sorted(map(tuple, rows)) == [("A", 2, 10.0), ("B, Inc", 7, None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.csv").write_text("symbol,sector,total_esg\nX,Banking,50\n")
    (tmp_path / "t" / "2.csv").write_text("total_esg,sector,symbol,beta\n60,Power,Y,1.5\n")
    got = {r["symbol"]: (r["sector"], r["total_esg"], r["beta"], r["imputed"]) for r in readers.read_esg_training(spark, str(tmp_path / "t")).collect()}
    assert got == {"X": ("Banking", 50.0, None, False), "Y": ("Power", 60.0, 1.5, False)}


def test_top_and_bottom_from_one_input(spark):
    scored = spark.createDataFrame([(1, f"h{i}", "n", float(v)) for i, v in enumerate([5, 1, 5, 9, 3, 7, 1])], "portfolio_id int, holding_id string, stock_name string, overall double")
    got = E.top_bottom_performers(scored, 3, 2)
    rows = sorted((r["side"], r["position"], r["holding_id"]) for r in got.collect())
    assert rows == [("bottom", 1, "h6"), ("bottom", 2, "h1"), ("top", 1, "h3"), ("top", 2, "h5"), ("top", 3, "h0")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_limits_need_no_nested_loop(spark):
    t = spark.createDataFrame([(p, n, float(v)) for p, n, v in L.TABLES["risk_threshold"][1]], "profile string, name string, value double")
    assert "NestedLoop" not in P.limit_breaches(holdings(spark), t)._jdf.queryExecution().executedPlan().toString()
