"""Compare Spark results with DuckDB: same columns by name, same rows in any order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    mine = spark_df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    a, b = canonical(spark_df.columns, mine), canonical(names, theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not wrong else f"{len(wrong)} rows differ, first {wrong[0]}"
