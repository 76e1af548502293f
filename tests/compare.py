"""Compare a Spark result with a DuckDB result, row for row."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, decimal.Decimal):
        raise TypeError("results hold no decimals, the two sides print them differently")
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def difference(df, con, sql: str, show: int = 3) -> str:
    """Empty if both sides hold the same rows under the same column names."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    want, got = rows(names, cur.fetchall()), rows(df.columns, df.collect())
    missing, extra = want - got, got - want
    if not missing and not extra:
        return "" if want else "both empty"
    return (f"{sum(want.values())} expected, {sum(got.values())} found; {sum(missing.values())} missing, "
            f"{sum(extra.values())} extra; columns {sorted(names)}; "
            f"missing {sorted(missing, key=str)[:show]}; extra {sorted(extra, key=str)[:show]}")
