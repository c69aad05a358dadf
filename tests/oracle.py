"""Compare a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def views(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark_df, con, sql: str) -> None:
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(spark_df.columns) == sorted(rel.columns)
    assert len(got) == len(want), f"{len(got)} rows, SQL has {len(want)}"
    for a, b in zip(got, want):
        assert a == b, f"{a}\n{b}"
