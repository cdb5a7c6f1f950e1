"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import os
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and x != x):
        return "" if x is None else "nan"
    if isinstance(x, float):
        return f"{x + 0.0:.6f}"
    return str(x)


def rows_of(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs. Doubles are compared to six decimals."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    res = con.sql(sql)
    want = res.fetchall()
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} <> {sorted(res.columns)}"
    g, w = rows_of(df.columns, got), rows_of(res.columns, want)
    if g == w:
        return None
    from collections import Counter

    a, b = Counter(g), Counter(w)
    return f"rows {len(g)} <> {len(w)}; only spark {list((a - b))[:3]}; only sql {list((b - a))[:3]}"


if __name__ == "__main__":
    from sitescan import build_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="compare-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    for pair in filter(None, os.environ.get("COMPARE_CONF", "").split(",")):
        spark.conf.set(*pair.split("=", 1))
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, q in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                diff = compare(spark, con, q, oracle[name], sf_dir)
            else:
                diff = None if q(spark, sf_dir).collect() else "empty"
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{name:32s} {time.time() - t0:6.2f}s {'ok' if diff is None else 'BAD ' + diff}", flush=True)
    print("bad:", bad)
