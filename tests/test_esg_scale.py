"""Scores and weights of holdings: each step is worked out once, with the same results."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import esg as E
from foliospark.operators import portfolio as P
from foliospark.plans import q_esg

ROWS = [(1, "a", "A", "X", 40.0, 10.0), (1, "b", "B", "Y", 60.0, 30.0), (1, "c", "C", "X", 60.0, 60.0), (2, "d", "D", "X", 55.0, 5.0), (2, "e", "E", "Y", 55.0, 5.0),
        (None, "f", "F", "X", 10.0, 1.0), (None, "g", "G", "X", 20.0, 3.0), (3, "h", "H", "X", None, 7.0), (3, "i", "I", "X", 30.0, 7.0), (3, "j", "J", "X", 31.0, 6.0)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(ROWS, "portfolio_id int, holding_id string, stock_name string, sector string, overall double, value double")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_potential_sums_up_the_holdings_once(scored):
    found = E.improvement_potential(scored)
    assert "Join" not in plan(found)
    assert {r["portfolio_id"]: tuple(r)[1:] for r in found.collect()} == {1: (58.0, 1, 63.0), 2: (55.0, 0, 55.0), None: (17.5, 0, 17.5), 3: (19.8, 1, 24.8)}


def test_candidates_take_both_totals_in_one_join(scored):
    found = E.improvement_candidates(scored)
    assert plan(found).count("Join") == plan(P.weights(scored)).count("Join")
    rows = {r["holding_id"]: (r["avg_esg"], r["gap"], r["weight_pct"]) for r in found.collect()}
    assert rows == {"a": (53.3333, 13.3333, 10.0), "f": (15.0, 5.0, 25.0), "i": (30.5, 0.5, 35.0)}
    assert {r["holding_id"] for r in E.improvement_candidates(P.weights(scored)).collect()} == set(rows)
    # weights are those of the holdings the scored rows are drawn from
    twice = E.improvement_candidates(scored.unionByName(scored), of=scored).collect()
    assert sorted((r["holding_id"], r["weight_pct"]) for r in twice) == [("a", 10.0), ("a", 10.0), ("f", 25.0), ("f", 25.0), ("i", 35.0), ("i", 35.0)]


@pytest.mark.parametrize("name, most", [("e20_esg_sector_breakdown", 0), ("e27_esg_recommendations", 0), ("e28_esg_text_report", 0), ("e26_improvement_candidates", 0)])
def test_holdings_are_joined_once(spark, name, most):
    found = q_esg.query.__globals__["QUERIES"][name](spark, "/root/testdata/sf0.001")
    assert plan(found).count("l_orderkey") == most  # the joined holdings are read back
    assert found.agg(F.count(F.lit(1))).first()[0] > 0
