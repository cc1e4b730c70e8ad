"""Where every query of the engine is registered, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
found: dict[str, Query] = {}
oracle: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of (spark, sf_dir), and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        found[f.__name__] = f
        if sql is not None:
            oracle[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
