"""Runs a query in Spark and its SQL in DuckDB and compares the rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    return v


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if Spark and DuckDB agree, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    own = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    theirs_names = [d[0] for d in rel.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if own == theirs:
        return ""
    return f"{sum(own.values())} rows and {sum(theirs.values())}; {names}; only Spark: {list((own - theirs))[:2]}; only SQL: {list((theirs - own))[:2]}"
