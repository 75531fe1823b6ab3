"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(table) -> Counter:
    """Rows of an Arrow table by value, with columns in the order of their names."""
    columns = [table[c].to_pylist() for c in sorted(table.column_names)]
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in zip(*columns))


def kinds(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema if "timestamp" not in str(f.type)}


def difference(found, expected) -> str:
    """Empty if columns, types and rows agree."""
    if sorted(found.column_names) != sorted(expected.column_names):
        return f"columns {found.column_names} != {expected.column_names}"
    if kinds(found) != kinds(expected):
        return f"types {set(kinds(found).items()) ^ set(kinds(expected).items())}"
    a, b = rows_of(found), rows_of(expected)
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only found {list((a - b).items())[:2]}, only expected {list((b - a).items())[:2]}"
