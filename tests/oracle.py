"""Comparison of the registered queries with their SQL, on one folder of tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def sql_rows(db, sql: str) -> tuple[list[str], list[tuple]]:
    names = sorted(row[0] for row in db.execute(f"DESCRIBE ({sql})").fetchall())
    shown = ", ".join(f'"{name}"' for name in names)
    return names, db.execute(f"SELECT {shown} FROM ({sql})").fetchall()


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(row) for row in df.select(*names).collect()]


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))
