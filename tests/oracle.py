"""Runs a query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import os

import duckdb


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat()[:10] if hasattr(value, "isoformat") else value


def both(spark, query, sql: str, sf_dir: str):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    done = con.execute(sql)
    names = [x[0] for x in done.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in done.fetchall()), key=repr)
    return ours, theirs
