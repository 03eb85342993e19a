"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "nan")
    return (2, str(value))


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple(_key(v) for v in row))


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """Human-readable differences, empty if rows, names and types agree exactly."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} <> {sorted(relation.columns)}"]
    found = []
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    sql_types = dict(zip(relation.columns, map(str, relation.types)))
    for n in names:
        if KINDS.get(spark_types[n]) != sql_types[n]:
            found.append(f"type of {n}: {spark_types[n]} <> {sql_types[n]}")
    ours = _sorted([tuple(row[n] for n in names) for row in df.collect()])
    order = [relation.columns.index(n) for n in names]
    theirs = _sorted([tuple(row[i] for i in order) for row in relation.fetchall()])
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} <> {len(theirs)}")
    left, right = set(ours), set(theirs)
    for row in list(left - right)[:limit]:
        found.append(f"only spark {dict(zip(names, row))}")
    for row in list(right - left)[:limit]:
        found.append(f"only sql   {dict(zip(names, row))}")
    if len(left - right) > limit:
        found.append(f"{len(left - right)} rows differ")
    return found
