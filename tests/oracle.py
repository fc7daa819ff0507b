"""Rows of a Spark result and of DuckDB SQL, made comparable."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf_dir) / t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal, float)):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    a, b = bag(spark_df.columns, spark_df.collect()), bag(names, rel.fetchall())
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
