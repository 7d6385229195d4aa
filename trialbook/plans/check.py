"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _key(row):
    return tuple((x is not None, type(x).__name__ if x is not None else "", x if x is not None else 0) for x in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=_key)


def rows_of_duck(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return names, sorted(rows, key=_key)


def difference(spark_df, con, sql) -> str | None:
    """None when both give the same columns and rows, else what differs first."""
    a_names, a = rows_of_spark(spark_df)
    b_names, b = rows_of_duck(con, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y or [type(p) for p in x] != [type(q) for q in y]:
            return f"{x} and {y} ({sum(p != q for p, q in zip(a, b))} rows differ)"
    return None
