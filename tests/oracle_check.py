"""Run registered queries next to their SQL and compare rows, order aside."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    return names, result.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def differences(df, sf_dir: str, sql: str) -> str | None:
    """None where both sides agree, else the first difference."""
    names, rows = comparable(df.columns, [tuple(row) for row in df.collect()])
    want_names, want = comparable(*sql_rows(sf_dir, sql))
    if names != want_names:
        return f"columns {names} <> {want_names}"
    if len(rows) != len(want):
        return f"{len(rows)} rows <> {len(want)}"
    for got, expected in zip(rows, want):
        if got != expected:
            return f"{got!r} <> {expected!r}"[:1500]
    return None
