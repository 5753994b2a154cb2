"""Run registered queries on Spark and their SQL on DuckDB, and compare values exactly."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


SECONDS: dict[str, float] = {}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(x)) for x in t))


_KIND = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool", "date": "date"}
_DUCK = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "bool", "DATE": "date"}


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short text saying what differs."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    SECONDS["spark"], t = time.time() - t, time.time()
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    SECONDS["duckdb"] = time.time() - t
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(set(df.columns) ^ set(cols))}"
    dt = {c[0]: _DUCK.get(str(c[1]), str(c[1])) for c in rel.description}
    st = {c: _KIND.get(t, t) for c, t in df.dtypes}
    bad = {c: (st[c], dt[c]) for c in cols if st[c] != dt[c]}
    if bad:
        return f"types spark/duckdb {bad}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if len(a) != len(b):
        return f"rows spark {len(a)} duckdb {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ over {sorted(cols)}, e.g. {diff[0]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from tests.conftest import session
    spark = session()
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    con = duck(sf_dir)
    con.execute("SET threads=8")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, name, fn, sqls[name], sf_dir)
                status = "ok" if msg is None else "DIFF " + msg[:700]
            else:
                status = f"rows {len(fn(spark, sf_dir).collect())}"
        except Exception as e:  # report and go on
            status = "ERROR " + str(e)[:700]
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - t:6.2f}s (spark {SECONDS.get('spark', 0):.2f} duckdb {SECONDS.get('duckdb', 0):.2f}) {name}: {status}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
