"""Runs a registered query and its DuckDB counterpart and compares rows and types."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _row(r):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else repr(x + 0.0) if isinstance(x, float) else str(x) for x in r)


KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool", "date": "date32[day]", "timestamp_ntz": "timestamp[us]"}


def compare(df, sql, sf):
    cols = sorted(df.columns)
    con = connect(sf)
    want = con.sql(sql)
    assert sorted(want.columns) == cols, (sorted(want.columns), cols)
    arrow = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.arrow()
    kinds = {f.name: str(f.type) for f in arrow.schema}
    mine = dict(df.dtypes)
    bad = {c: (mine[c], kinds[c]) for c in cols if KINDS.get(mine[c], mine[c]) != kinds[c] and kinds[c] != "null"}
    a = sorted(_row([r[c] for c in cols]) for r in (x.asDict() for x in df.collect()))
    b = sorted(_row([r[c] for c in cols]) for r in arrow.to_pylist())
    diff = [x for x in zip(a, b) if x[0] != x[1]][:3]
    return len(a), len(b), bad, diff
