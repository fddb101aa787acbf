"""Queries by name, each with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; without SQL only its rows are checked."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None) -> Column:
    """Rounded to 6 digits, the precision both engines are compared at."""
    column = c if isinstance(c, Column) else F.col(c)
    return F.round(column, 6).alias(name or c)


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f"`{n}`", n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
