"""Joins that shuffle rows only where they must, and broker files written and read by many tasks."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import skew
from foliospark.operators import esg as E
from foliospark.operators import intake as N
from foliospark.operators import market as M
from foliospark.plans import q_sources
from foliospark.plans.queries import QUERIES
from foliospark.sources import readers, writers


@pytest.fixture
def shuffled_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimension_joined_on_the_key_without_another_shuffle(spark, shuffled_joins):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    fact = spark.createDataFrame([(i, k) for i, k in enumerate([1, 1, 2, 9, None, None, 1])], "id int, k int").repartition(8, "k")
    out = skew.join_dimension(fact, dim, "k", ["id"], max_rows=2)
    assert plan(out).count("Exchange hashpartitioning") == 2  # fact's own and dim's
    expected = [(0, 1, "a"), (1, 1, "a"), (2, 2, "b"), (3, 9, None), (4, None, None), (5, None, None), (6, 1, "a")]
    assert sorted(map(tuple, out.collect())) == expected
    for hot_rows in (0, 1, 2):  # hot keys, with and without a partner, null among them
        out = skew.join_dimension(fact, dim, "k", ["id"], max_rows=2, hot_rows=hot_rows)
        assert sorted(map(tuple, out.collect())) == expected


def test_days_of_a_portfolio_are_not_shuffled(spark):
    day = lambda i: dt.date(2024, 1, 1 + i)
    prices = spark.createDataFrame([(s, day(i), float(100 + s * i)) for s in (1, 2, 7) for i in range(3)], "symbol int, dt date, close double")
    h = spark.createDataFrame([(10, 1, 50.0), (10, 1, 50.0), (10, 2, 100.0), (11, 5, 9.0), (12, 2, 0.0)], "portfolio_id int, symbol int, value double")
    out = M.historical_var(h, prices)
    text = plan(out)
    assert "dt#" not in "".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", text))
    rows = {r["portfolio_id"]: r for r in out.collect()}
    assert set(rows) == {10, 12}
    r = [1.0 / 100 * 0.5 + 2.0 / 100 * 0.5, 1.0 / 101 * 0.5 + 2.0 / 102 * 0.5]
    low, high = min(r), max(r)
    assert rows[10]["days"] == 2
    assert rows[10]["var_95"] == pytest.approx((low + 0.05 * (high - low)) * 200, abs=0.006)
    assert rows[12]["var_95"] is None


def broker(spark):
    lines = ["Stock Name,Quantity,Average buy price,Closing value", "Infosys Limited,1,2,(30.5)", "Infosys Limited,1,2,₹9.5", "HDFC Bank,1,2,7"]
    return spark.createDataFrame([(f, i, x) for f in (1, 2, 30) for i, x in reversed(list(enumerate(lines)))], "file_id long, pos long, line string")


def test_broker_files_written_by_tasks(spark, tmp_path):
    folders = writers.write_broker_files(broker(spark), str(tmp_path / "files"))
    files = sorted(p.relative_to(tmp_path / "files").parts for p in (tmp_path / "files").rglob("*.txt"))
    assert sorted(name for _, name in files) == ["file_id=1.txt", "file_id=2.txt", "file_id=30.txt"]  # in flat folders, one a task
    assert {f"{tmp_path}/files/{folder}" for folder, _ in files} == set(folders)
    back = readers.read_broker_lines(spark, folders).coalesce(1).collect()
    for name in ("1", "2", "30"):
        own = sorted((r["pos"], r["line"]) for r in back if r["file_id"].endswith(f"/file_id={name}.txt"))
        assert [x for _, x in own] == [r["line"] for r in broker(spark).filter(F.col("file_id") == int(name)).orderBy("pos").collect()]
    none = writers.write_broker_files(broker(spark).filter("file_id < 0"), str(tmp_path / "none"))
    assert readers.read_broker_lines(spark, none).count() == 0


def test_names_of_files_do_not_pass_the_driver(spark, tmp_path):
    texts = {"a": "one\ntwo\n\nfour", "b": "\ufeffx\r\ny\rz\n" + "long " * 30 + "\r\n\r\nü€\n", "empty": "", "end": "\n", "c": "".join(f"{i * i}\n" for i in range(200))}
    for name, text in texts.items():
        (tmp_path / ("1" if name < "c" else "2")).mkdir(exist_ok=True)
        (tmp_path / ("1" if name < "c" else "2") / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "1" / "_hidden").write_text("no\n")
    folders = [f"file://{tmp_path}/1", f"{tmp_path}/2"]
    key = lambda df: {n: [r["line"] for r in sorted(df.collect(), key=lambda r: r["pos"]) if r["file_id"].endswith(f"/{n}.txt")] for n in texts}
    want = key(readers.read_broker_lines(spark, folders))
    for piece in (1 << 24, 64, 7, 3, 2, 1):  # however the files are cut, also inside a line's end
        got = readers.read_broker_folders(spark, folders, piece)
        assert key(got) == want and got.select("file_id", "pos").distinct().count() == got.count() == sum(map(len, want.values()))
    assert got.inputFiles() == []  # Spark's own index of files lies on the driver


def test_one_file_for_each_portfolio_without_an_index(spark, monkeypatch):
    read, calls = readers.read_broker_folders, []
    monkeypatch.setattr(readers, "read_broker_lines", None)
    monkeypatch.setattr(readers, "read_broker_folders", lambda *a: calls.append(a) or read(*a))
    assert QUERIES["x1_read_files_to_stress"](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_lines_join_the_facts_of_their_file_once(spark):
    rows = N.BrokerFiles(broker(spark)).rows
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(" AS _salt#") == 1
    got = sorted((r["file_id"], r["stock_name"], r["current_value"]) for r in rows.collect())
    assert got == [(f, *x) for f in (1, 2, 30) for x in (("HDFC Bank", 7.0), ("Infosys Limited", -30.5), ("Infosys Limited", 9.5))]


def test_names_are_summed_up_before_they_get_sectors(spark):
    out = q_sources._by_sector_of_names(N.BrokerFiles(broker(spark)).rows)
    got = {(r["portfolio_id"], r["stock_name"]): (r["value"], r["n"]) for r in out.collect()}
    assert len(got) == out.count() == 6
    assert got[(30, "Infosys Limited")][1] == 2


def test_top_and_bottom_by_one_shuffle_and_sort(spark, shuffled_joins):
    rows = [(p, f"h{i:02d}", "x", s) for p in (1, 2, None) for i, s in enumerate([50.0, None, 70.0, 50.0, 20.0, 90.0, None, 10.0, 50.0][:9 if p == 1 else 4])]
    scored = spark.createDataFrame(rows, "portfolio_id int, holding_id string, stock_name string, overall double")
    expected = set()
    for p in (1, 2, None):
        order = sorted((r for r in rows if r[0] == p), key=lambda r: (r[3] is None, -(r[3] or 0), r[1]))
        expected |= {(*r, i, "top") for i, r in enumerate(order[:5], 1)} | {(*r, i, "bottom") for i, r in enumerate(order[::-1][:3], 1)}
    out = E.top_bottom_performers(scored, portfolio_keys=scored)
    assert plan(out).count("Exchange hashpartitioning") == 1 and "Generate" in plan(out).split("Exchange hashpartitioning")[0]
    assert plan(out).count("Sort [") == 1
    for hot_rows in (100, 5, 0):  # none, one and all of the portfolios are hot
        got = list(map(tuple, E.top_bottom_performers(scored, portfolio_keys=scored, hot_rows=hot_rows).collect()))
        assert len(got) == len(set(got)) and set(got) == expected
