"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return value


def difference(df, con, sql: str) -> str | None:
    """None when both have the same columns, types by kind and rows; else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    columns = sorted(names)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    spark_kinds = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in columns:
        want = same.get(spark_kinds[c])
        if want and kinds[c] != want:
            return f"type of {c}: {spark_kinds[c]} != {kinds[c]}"
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    if ours == theirs:
        return None
    only = list((ours - theirs).items())[:2]
    missing = list((theirs - ours).items())[:2]
    return f"{sum(ours.values())} vs {sum(theirs.values())} rows; only Spark {only}; only SQL {missing}"[:1500]
