"""Run one registered query on Spark and its SQL on DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimal result: cast it to double or bigint")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = cursor.fetchall()
    columns = spark_df.columns
    if sorted(columns) != sorted(names):
        return False, f"columns {sorted(columns)} != {sorted(names)}"
    left = [tuple(r) for r in spark_df.collect()]
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}"
    order = sorted(columns)
    pick = lambda names_, rows: sorted(
        (tuple(plain(r[names_.index(c)]) for c in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    )
    a, b = pick(list(columns), left), pick(names, right)
    if a == b:
        kinds = [(type(x).__name__, type(y).__name__) for r, s in zip(a, b) for x, y in zip(r, s) if type(x) is not type(y)]
        if kinds:
            return False, f"types differ: {sorted(set(kinds))}"
        return True, f"{len(a)} rows"
    for r, s in zip(a, b):
        if r != s:
            return False, f"first difference\n  spark  {dict(zip(order, r))}\n  duckdb {dict(zip(order, s))}"
    return False, "differ"
