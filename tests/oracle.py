"""Compare a query with its DuckDB SQL over one folder of test tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if hasattr(v, "__int__") and not isinstance(v, (str, bytes)) else v


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (names, cols)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
