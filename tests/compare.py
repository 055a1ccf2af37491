"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from dataroute.queries.inputs import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_bag(df: DataFrame) -> Counter:
    return _bag(df.columns, df.collect())


def duck_bag(connection, sql: str) -> Counter:
    result = connection.execute(sql)
    return _bag([column[0] for column in result.description], result.fetchall())


def schemas(df: DataFrame, connection, sql: str) -> tuple[dict, dict]:
    """Column types of both sides, in the names that DuckDB uses."""
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
        "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT",
    }
    ours = {
        field.name: names.get(field.dataType.simpleString(), field.dataType.simpleString())
        for field in df.schema.fields
    }
    result = connection.execute(sql)
    theirs = {column[0]: str(column[1]) for column in result.description}
    return ours, theirs
