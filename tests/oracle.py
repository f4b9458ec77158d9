"""Compares a registered query with its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else 0.0 if value == 0 else value
    return value


def difference(df, con, sql: str) -> str:
    """Empty if a DataFrame and a SQL result agree in columns, kinds and rows; else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = dict(zip(names, (str(d[1]) for d in result.description)))
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    for name, kind in df.dtypes:
        got = kinds[name].upper()
        if got not in (same.get(kind), "STRING" if kind == "string" else None, "NUMBER"):
            return f"column {name}: {kind} and {got}"
    order = sorted(names)
    want = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    if len(want) != len(have):
        return f"{len(have)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(bad)} rows differ, such as {order} {bad[0]}" if bad else ""
