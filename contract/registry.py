"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.scale.staging import ensure_shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def _widened(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, so that both engines report the same types."""
    return df.select(*[F.col(f"`{c}`").cast(_WIDER.get(kind, kind)).alias(c) for c, kind in df.dtypes])


def _run(fn: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_dir(spark)
    return _widened(fn(spark, sf_dir))


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: _run(fn, spark, sf_dir)
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register
