"""Compare a Spark result with the DuckDB result of its SQL: same columns, rows and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, datetime.datetime):
        v = v.date()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(plain, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    cur = con.execute(sql)
    o_cols, o_rows = _rows([d[0] for d in cur.description], cur.fetchall())
    s_cols, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    if s_cols != o_cols:
        return [f"columns {s_cols} != {o_cols}"]
    if len(s_rows) != len(o_rows):
        return [f"{len(s_rows)} rows != {len(o_rows)}", f"{s_rows[:3]}", f"{o_rows[:3]}"]
    bad = [f"{a} != {b}" for a, b in zip(s_rows, o_rows) if a != b]
    return [f"{len(bad)} rows differ", *bad[:limit]] if bad else []
