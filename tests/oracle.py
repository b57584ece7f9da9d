"""Run a registered query beside its SQL and compare the two results."""
from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
    return [names[i] for i in order], out


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    rel = con.execute(sql)
    return rows_of([d[0] for d in rel.description], rel.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    names, left = spark_rows(df)
    other, right = duck_rows(con, sql)
    if names != other:
        return f"columns {names} != {other}"
    if left == right:
        return None
    a, b = set(left), set(right)
    extra = sorted(a - b, key=repr)[:3]
    missing = sorted(b - a, key=repr)[:3]
    return f"rows {len(left)} vs {len(right)}; only spark {extra}; only sql {missing}"
