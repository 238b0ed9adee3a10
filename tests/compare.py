"""Spark results against the same query in SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in records)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    columns = df.columns
    got = rows(columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} against {sorted(names)}"
    want = rows(names, result.fetchall())
    if got == want:
        return None
    only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; only in one: {only}"
