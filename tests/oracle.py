"""Runs a query and its SQL over the same Parquet files and compares names, types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Spark type -> DuckDB type; what is not listed is compared as text.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(x):
    return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)


def rows_of(rows, order):
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, con) -> list[str]:
    """What is unequal, in words; empty if nothing is."""
    found = con.sql(sql)
    names, kinds = list(found.columns), [str(t) for t in found.types]
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    have = dict(df.dtypes)
    out += [f"{n}: {have[n]} against {k}" for n, k in zip(names, kinds, strict=True) if KINDS.get(have[n], k) != k]
    order = sorted(names)
    a = rows_of(df.collect(), [df.columns.index(n) for n in order])
    b = rows_of(found.fetchall(), [names.index(n) for n in order])
    if len(a) != len(b):
        out.append(f"{len(a)} rows against {len(b)}")
    elif a != b:
        i = next(i for i in range(len(a)) if a[i] != b[i])
        out.append(f"row {i}: {a[i]} against {b[i]}")
    return out
