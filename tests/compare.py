"""Run queries on Spark and their SQL on DuckDB and compare every value."""

from __future__ import annotations

import math
import os
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def sort_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df):
    order = sorted(df.columns)
    return order, sort_rows([tuple(normal(v) for v in row) for row in df.select(*order).collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(normal(r[i]) for i in order) for r in result.fetchall()]
    return [names[i] for i in order], sort_rows(rows)


def difference(df, con, sql):
    """None when both results are the same, else a short description."""
    names, mine = spark_rows(df)
    their_names, theirs = duck_rows(con, sql)
    if names != their_names:
        return f"columns {names} against {their_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    if not mine:
        return "no rows"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first {wrong[0][0]} against {wrong[0][1]} for {names}"
    return None
