"""Runs a query and its SQL over the same tables and compares all rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, sorted; floats to nine digits."""
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else (str(v) if not isinstance(v, (int, bool, type(None))) else int(v) if v is not None else None)
    return sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=repr)


def same(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    names = got.columns
    found = con.execute(sql)
    expected_names = [c[0] for c in found.description]
    assert sorted(names) == sorted(expected_names)
    assert rows_of(names, [tuple(r) for r in got.collect()]) == rows_of(expected_names, found.fetchall())
