"""How a query and the SQL that says the same are put in the catalogue."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL of its oracle where there is one."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = inspect.cleandoc(oracle)
        return run

    return add


def sql_literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, bytes):
        return f"unhex('{value.hex()}')"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(sql_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with literal rows for an oracle; columns: 'a long, b string' as for Spark."""
    kinds = {"long": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean", "binary": "blob", "array<string>": "varchar[]", "array<double>": "double[]", "array<long>": "bigint[]"}
    fields = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows)
    cast = ", ".join(f"cast({n} as {kinds[k]}) as {n}" for n, k in fields)
    return f"{name} as (select {cast} from (values {body}) as _v({', '.join(n for n, _ in fields)}))"


def frame(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)
