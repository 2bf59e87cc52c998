"""Comparison of query results with DuckDB on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with a view per test table."""
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    """Comparable form of one cell."""
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, dict):
        return tuple((k, canonical(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(canonical(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "item"):
        return canonical(value.item())
    return value


def rows_of(table) -> list[tuple]:
    """Sorted canonical rows of an Arrow table, columns in name order."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(canonical(c[i]) for c in columns) for i in range(table.num_rows)), key=repr)


def differences(spark_table, oracle_table, limit: int = 5) -> list[str]:
    """What differs; an empty list means equal columns, types and values."""
    notes = []
    left = {f.name: str(f.type) for f in spark_table.schema}
    right = {f.name: str(f.type) for f in oracle_table.schema}
    if set(left) != set(right):
        return [f"columns {sorted(left)} vs {sorted(right)}"]
    for name in left:
        a, b = left[name].replace("large_", ""), right[name].replace("large_", "")
        if a != b:
            notes.append(f"type of {name}: {a} vs {b}")
    a, b = rows_of(spark_table), rows_of(oracle_table)
    if len(a) != len(b):
        notes.append(f"rows {len(a)} vs {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        notes.append(f"{len(wrong)} rows differ; columns {sorted(left)}")
        notes += [f"  spark {x}\n  duckdb {y}" for x, y in wrong[:limit]]
    return notes
