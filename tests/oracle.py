"""Queries against their SQL on one folder of tables."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from collections import Counter  # noqa: E402

import duckdb  # noqa: E402
from compare import norm  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


def same(spark, con, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    heads = [d[0] for d in cur.description]
    theirs = Counter(tuple(norm(dict(zip(heads, r))[c]) for c in cols) for r in cur.fetchall())
    assert sorted(heads) == cols
    assert ours == theirs
