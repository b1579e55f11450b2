"""Comparison of a Spark result with the DuckDB SQL of the same query."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        if isinstance(v, dict):
            return "{" + ",".join(f"{k}={one(x)}" for k, x in sorted(v.items())) + "}"
        if hasattr(v, "asDict"):
            return one(v.asDict())
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(one, v)) + "]"
        return repr(v)

    return sorted("|".join(map(one, r)) for r in rows)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    out = con.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    return [out.columns[i] for i in order], canonical(tuple(r[i] for i in order) for r in out.fetchall())


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, canonical(tuple(r[c] for c in columns) for r in df.collect())
