"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _sorted(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, text: str):
    found = con.execute(text)
    return _sorted([d[0] for d in found.description], found.fetchall())


def difference(left, right) -> str | None:
    """None if equal in names, values and value types; else the first differences."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    return f"{len(wrong)} rows differ, such as {wrong[:3]}" if wrong else None
