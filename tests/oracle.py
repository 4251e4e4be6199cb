"""Runs a registered query and its SQL in DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], data: dict) -> list[str]:
    return sorted(map(repr, zip(*[data[c] for c in columns], strict=True)))


def both(spark, sf_dir: str, query, sql: str) -> tuple[list[str], list[str]]:
    """Sorted rows of either side, columns by name."""
    got = query(spark, sf_dir).toArrow()
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    want = con.sql(sql).to_arrow_table()
    columns = sorted(got.schema.names)
    assert columns == sorted(want.schema.names)
    return rows_of(columns, got.to_pydict()), rows_of(columns, want.to_pydict())
