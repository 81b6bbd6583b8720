"""Run a query on Spark and its SQL on DuckDB, and compare every value."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf, f"{name}.parquet")
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.isoformat())
    return (type(v).__name__, str(v))


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(spark, con, run, sql: str, sf: str) -> list[str]:
    """Empty when names, types, row count and all values agree."""
    df = run(spark, sf)
    mine = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    theirs = rel.fetchall()
    out = []
    left, right = sorted(df.columns), sorted(rel.columns)
    if left != right:
        return [f"columns {left} against {right}"]
    spark_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    out += [f"type of {c}: {spark_types[c]} against {duck_types[c]}" for c in left if spark_types[c] != duck_types[c]]
    if len(mine) != len(theirs):
        out.append(f"{len(mine)} rows against {len(theirs)}")

    def rows(data, names):
        at = [names.index(c) for c in left]
        return sorted(tuple(_plain(r[i]) for i in at) for r in data)

    a, b = rows(mine, df.columns), rows(theirs, list(rel.columns))
    if a != b:
        only_a = sorted(set(a) - set(b))[:2]
        only_b = sorted(set(b) - set(a))[:2]
        out.append(f"values, e.g. {only_a} against {only_b}")
    return out
