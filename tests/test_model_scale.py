"""Scores and attributions of many rows: spread over tasks, patterns worked out for many leaves at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import boosting as B
from foliospark.operators import model as ML

from .test_portfolio import boosted


def one_task(spark, x):
    """All rows in one partition, as from a small file."""
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "symbol int, a double, b double, c double, d double").coalesce(1)


def test_scores_of_one_file_are_spread_over_tasks(spark):
    model, x, _ = boosted()
    scored = ML.predict_esg(one_task(spark, x), model, list("abcd"))
    found = {r["symbol"]: r["prediction"] for r in scored.collect()}
    assert [found[i] for i in range(len(x))] == pytest.approx(list(np.clip(model.predict(x), 0, 100)))
    # 200 perturbations a row, 50 rows a task
    spread = B.spread(one_task(spark, x), 1_000)
    assert spread.rdd.getNumPartitions() == min(18, spark.sparkContext.defaultParallelism) and spread.count() == len(x)
    assert "Exchange" in model.explain(one_task(spark, x), "symbol")._jdf.queryExecution().executedPlan().toString()


def test_scores_equal_a_walk_down_the_trees():
    model, x, _ = boosted(leaves=12, rounds=9)
    rows = np.concatenate([x, [[np.nan, 3.0, 50.0, -1.0], [0.0, np.nan, np.inf, -np.inf]]])

    def walk(t, i, row):
        f = model.feature[t, i]
        return model.value[t, i] if f < 0 else walk(t, model.lower[t, i] if row[f] <= model.threshold[t, i] else model.upper[t, i], row)
    assert model.predict(rows) == pytest.approx([model.base + sum(walk(t, 0, r) for t in range(model.trees)) for r in rows], abs=1e-9)


def test_leaf_patterns_are_worked_out_together(monkeypatch):
    model, x, _ = boosted(leaves=12, rounds=9)
    calls, plain = [], B.leaf_shares
    monkeypatch.setattr(B, "leaf_shares", lambda *a: calls.append(1) or plain(*a))
    found = model.attributions(x)
    assert len(calls) <= 4 < (model.feature < 0).sum()  # one call for all leaves with equally many conditions
    monkeypatch.setattr(B, "TABLE", 1)
    assert model.attributions(x) == pytest.approx(found, abs=1e-9)  # only the patterns that occur
    assert found.sum(axis=1) == pytest.approx(model.predict(x) - model.expected(), abs=1e-9)


def test_attributions_of_portfolios_are_made_once(spark):
    model, x, _ = boosted()
    parts = model.explain(one_task(spark, x[:30]), "symbol").withColumnRenamed("symbol", "security_id")
    h = spark.range(60).select((F.col("id") % 3).alias("portfolio_id"), (F.col("id") % 20).cast("int").alias("security_id"), F.lit(0.05).alias("weight"))
    whole = ML.portfolio_attribution(h, parts, model.expected())
    assert "EvalPython" not in whole._jdf.queryExecution().toString()
    sums = whole.groupBy("portfolio_id").agg(F.sum("contribution").alias("s"), F.first("base").alias("b"), F.first("prediction").alias("p")).collect()
    assert len(sums) == 3 and all(r["s"] + r["b"] == pytest.approx(r["p"], abs=1e-4) for r in sums)


def labelled(spark, n):
    rows = spark.range(n).selectExpr("id", "id * 37 % 1009 / 10.0D AS a", "id * 53 % 97 / 10.0D AS b", "cast(id % 2 AS double) AS c", "if(id % 3 = 0, 0.5D, 1.0D) AS weight",
                                     "if(id % 20 < 14, 'train', if(id % 20 < 17, 'val', 'test')) AS split")
    return rows.withColumn("y", F.expr("20 + 3 * a + 2 * b + if(c = 1, a * b, 0) + id % 7"))


def test_all_rows_are_fitted_whatever_their_number(spark):
    rows = labelled(spark, 140_000)  # 98,000 to train on: more than one task takes
    found = ML.train_esg(rows, ["a", "b", "c"], "y", rounds=12, step=0.3)
    kept = rows.filter("split <> 'test'").toPandas()
    train = (kept["split"] == "train").to_numpy()
    assert found.cover[:, 0] == pytest.approx([kept["weight"][train].sum()] * 12)
    # the same trees as from one task that has all of them
    x = kept[["a", "b", "c"]].to_numpy()
    cuts = B.cut_points(rows.filter("split = 'train'"), ["a", "b", "c"])
    base, trees = B.boost(x, kept["y"].to_numpy(), kept["weight"].to_numpy(), ~train, cuts, 12, 0.3, 50, 31, 20)
    assert found.base == pytest.approx(base) and [[n[0] for n in t] for t in trees] == [found.feature[i, :len(t)].tolist() for i, t in enumerate(trees)]
    assert [n[4] for t in trees for n in t] == pytest.approx([v for i, t in enumerate(trees) for v in found.value[i, :len(t)]], abs=1e-6)


def test_validation_rows_all_count_and_none_may_be_there(spark):
    rows = labelled(spark, 900)
    all_rounds = ML.train_esg(rows.filter("split = 'train'"), ["a", "b", "c"], "y", rounds=9)
    assert all_rounds.trees == 9 and ML.train_esg(rows.filter("false"), ["a", "b", "c"], "y").trees == 0
    # noise in validation ends the training early, however many rows there are
    noise = rows.withColumn("y", F.when(F.col("split") == "val", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("double")))
    assert ML.train_esg(noise, ["a", "b", "c"], "y", rounds=200, step=0.3, patience=5).trees < 100


def test_leaves_cut_ahead_give_the_same_trees():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (3000, 4)).astype(float)
    y, ones, cuts = x[:, 0] + np.where(x[:, 1] > 20, x[:, 2], 0) + rng.normal(size=3000), np.ones(3000), [np.arange(39.0)] * 4
    codes, owner = B.binned(x, cuts), np.repeat(np.arange(4), 40)
    calls = []
    plain = B.grow(codes, owner, -y, ones, 31, 20, 0.1, lambda s: calls.append(1) or s)
    one = B.grow(codes, owner, -y, ones, 31, 20, 0.1)
    assert plain[0] == one[0] and len(calls) < 30
    joint = B.joint_codes(codes, np.array([40] * 4))
    assert [f for f, _ in joint] == [[0, 1], [2, 3]]
    grouped = B.grow(codes, owner, -y, ones, 31, 20, 0.1, B.alone, joint)
    assert [n[:4] for n in grouped[0]] == [n[:4] for n in one[0]] and [n[4] for n in grouped[0]] == pytest.approx([n[4] for n in one[0]])


def test_leaves_of_a_subtree_are_looked_up_together(monkeypatch):
    model, x, _ = boosted(leaves=12, rounds=9)
    rows, leaves = np.concatenate([x, [[np.nan, 3.0, 50.0, -1.0], [0.0, np.nan, np.inf, -np.inf]]]), int((model.feature < 0).sum())
    sizes, found = [], []
    for states in (1, 30, 1 << 16):
        monkeypatch.setattr(B, "STATES", states)
        model.__dict__.pop("_groups", None)
        sizes.append(len(model._groups))
        found.append(model.attributions(rows))
        assert sum(len(g.leaves) for g in model._groups) == leaves
    assert sizes[0] == leaves > sizes[1] > sizes[2] == model.trees  # single leaves, subtrees, whole trees
    for other in found[1:]:
        assert other == pytest.approx(found[0], abs=1e-9)
    assert found[0].sum(axis=1) == pytest.approx(model.predict(rows) - model.expected(), abs=1e-9)


def test_scores_by_bits_whatever_the_number_of_rows_and_leaves(monkeypatch):
    monkeypatch.setattr(B, "PART", 100)
    for leaves in (2, 3, 12, 300):
        model, x, _ = boosted(leaves=leaves, rounds=3)
        trees = sum(np.array([[row(model, t, r) for r in x[:301]] for t in range(model.trees)]))
        for n in (0, 1, 63, 64, 65, 100, 301):
            assert model.predict(x[:n]) == pytest.approx(model.base + trees[:n], abs=1e-9)


def row(model, t, x):
    i = 0
    while model.feature[t, i] >= 0:
        i = (model.lower if x[model.feature[t, i]] <= model.threshold[t, i] else model.upper)[t, i]
    return model.value[t, i]


def test_portfolios_shuffle_one_row_each(spark):
    """A security twice, one without attributions, a portfolio without any, and features that not every security has."""
    attr = [(1, "a", 2.0), (1, "b", -3.0), (1, "a", 0.5), (2, "b", 1.0), (None, "a", 9.0)]
    long = spark.createDataFrame(attr, "security_id int, feature string, attribution double")
    h = spark.createDataFrame([(7, 1, 0.25), (7, 1, 0.25), (7, 3, 0.5), (8, 2, 1.0), (9, 3, 1.0), (None, 2, 1.0), (8, None, 0.5)], "portfolio_id int, security_id int, weight double")
    out = ML.portfolio_attribution(h, long, 10.0)
    want = {(7, "b", -1.5, 1, 5.0, 4.75, 0.5), (7, "a", 1.25, 2, 5.0, 4.75, 0.5), (8, "b", 1.0, 1, 10.0, 11.0, 1.0), (None, "b", 1.0, 1, 10.0, 11.0, 1.0)}
    assert {tuple(r) for r in out.collect()} == want
    wide = spark.createDataFrame([(1, [2.0, -3.0]), (1, [0.5, None]), (2, [None, 1.0]), (None, [9.0, None])], "security_id int, attributions array<double>")
    assert {tuple(r) for r in ML.portfolio_attribution(h, wide, 10.0, ["a", "b"]).collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("Exchange hashpartitioning(portfolio_id")  # features become rows after the last shuffle of holdings


def test_surrogate_of_trees_equals_the_one_by_rows(spark):
    model, x, _ = boosted()
    rows = one_task(spark, np.concatenate([x[:12], [[0.0, -3.0, 5.0, 0.0]]])).withColumn("symbol", F.expr("CASE WHEN symbol < 2 THEN null WHEN symbol = 3 THEN 4 ELSE symbol END"))

    class AnyModel:  # not known to be trees
        transform = model.transform
    for key in ("symbol", "name"):
        own = rows.withColumn("name", F.concat(F.lit("n"), F.col("symbol").cast("string")))
        got, want = (ML.local_surrogate(own, key, m, list("abcd"), samples=40, top=4) for m in (model, AnyModel()))
        value = lambda df: {(r[key], r["feature"]): r["weight"] for r in df.collect()}
        found, plain = value(got), value(want)
        assert found.keys() == plain.keys() and len(found) == 11 * 4  # rows of one key, also of none, are one fit
        assert [found[k] for k in plain] == pytest.approx(list(plain.values()), abs=1e-9)
    assert "explode(sequence" not in got._jdf.queryExecution().toString()  # no row for each perturbation


def test_hash_goes_on_from_the_columns_before(spark):
    df = spark.range(50).withColumn("t", F.concat(F.lit("k"), "id"))
    rows = df.select(F.xxhash64("t").alias("h"), F.col("id").cast("int").alias("i"), F.xxhash64("t", F.col("id").cast("int"), F.lit(42)).alias("want")).toPandas()
    with np.errstate(over="ignore"):
        got = ML.hash_int(42, ML.hash_int(rows["i"].to_numpy(), rows["h"].to_numpy(np.int64).view(np.uint64)))
    assert (got.view(np.int64) == rows["want"].to_numpy()).all()
