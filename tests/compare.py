"""Compare a query with its oracle statement: columns, row counts and values, in any order."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    return repr(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def check(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """None if both agree, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    result = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    wrong = {c: (k, kinds[c]) for c, k in df.dtypes if _KINDS.get(k) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    a, b = _rows(df.columns, ours), _rows(columns, theirs)
    if a != b:
        return f"values {[(x, y) for x, y in zip(a, b) if x != y][:2]}"
    return None
