"""Compare registered queries with their SQL on the same parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (bytearray, bytes)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT",
               "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]",
               "array<float>": "FLOAT[]", "array<double>": "DOUBLE[]"}


def differences(df, connection, sql: str) -> list[str]:
    """What differs, empty if nothing."""
    relation = connection.sql(sql)
    problems = []
    if sorted(df.columns) != sorted(relation.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(relation.columns)}"]
    types = dict(zip(relation.columns, map(str, relation.types)))
    for field in df.schema.fields:
        mine = SPARK_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if mine != types[field.name]:
            problems.append(f"type of {field.name}: {mine} vs {types[field.name]}")
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(relation.columns, relation.fetchall())
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows vs {len(theirs)}")
    elif mine != theirs:
        first = next((a, b) for a, b in zip(mine, theirs) if a != b)
        problems.append(f"values differ, first: {first}")
    return problems
