"""Compare a query's rows with its SQL's, both over the same tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else str(v) if isinstance(v, bool) else float(v) if hasattr(v, "as_tuple") else v
    return [columns[i] for i in order], Counter(tuple(clean(r[i]) for i in order) for r in data)


def of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    return rows([c[0] for c in found.description], found.fetchall())


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
