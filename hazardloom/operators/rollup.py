"""Counts by place and type, enrichment, alignment, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .ordered import OrderedRows
from .schema import q
from .sizing import small

# Key sets tried in this order when a column is copied from another table.
KEY_SETS = [
    ["Date", "Time", "Accident Type"],
    ["Date", "Accident Type"],
    ["Time", "Accident Type"],
]


def top_groups(df: DataFrame, col: str, n: int = 10, include_na: bool = False, out: str = "accident_count") -> DataFrame:
    """Largest groups by row count, ties by name."""
    rows = df if include_na else df.where(F.col(q(col)).isNotNull())
    return rows.groupBy(F.col(q(col))).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.col(q(col))).limit(n)


def code_mapping(df: DataFrame, code: str, label: str) -> DataFrame:
    """Distinct code and label pairs without nulls, by code."""
    return (
        df.select(F.col(q(code)).alias("accident_type_code"), F.col(q(label)).alias("accident_type"))
        .na.drop()
        .distinct()
        .orderBy("accident_type_code")
    )


def _pair_counts(df: DataFrame, row: str, col: str, include_na: bool) -> DataFrame:
    pairs = df.select(F.col(q(row)).cast("string").alias("r"), F.col(q(col)).cast("string").alias("c"))
    pairs = pairs.na.fill("(Missing)") if include_na else pairs.na.drop()
    return pairs.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))


def percent_long(df: DataFrame, row: str, col: str, include_na: bool = False, decimals: int = 2) -> DataFrame:
    """``(row, col, n, percent)`` of the pairs that occur, for any number of column values."""
    counts = _pair_counts(df, row, col, include_na)
    totals = counts.groupBy("r").agg(F.sum("n").alias("total"))
    return counts.join(totals, "r").select(
        F.col("r").alias(row), F.col("c").alias(col), "n",
        F.bround(F.col("n") / F.col("total") * 100, decimals).alias("percent"),
    )


def percent_crosstab(
    df: DataFrame, row: str, col: str, include_na: bool = False, decimals: int = 2, values: list[str] | None = None
) -> DataFrame:
    """Share of each column value inside its row, one column per value.

    The pairs are counted first, so the pivot sees counts and not rows.
    """
    counts = _pair_counts(df, row, col, include_na)
    wide = counts.groupBy("r").pivot("c", values).agg(F.first("n"))
    names = [c for c in wide.columns if c != "r"]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(q(c)), F.lit(0)) for c in names])
    return wide.select(
        F.col("r").alias(row),
        *[F.bround(F.coalesce(F.col(q(c)), F.lit(0)) / total * 100, decimals).alias(c) for c in names],
    )


def align_by_position(
    left: DataFrame, right: DataFrame, order_left: list, order_right: list, rows_per_bucket: int | None = None
) -> DataFrame:
    """Rows of two tables side by side by position in the given orders; lengths must agree."""
    if left.count() != right.count():
        raise ValueError("tables of different length cannot be aligned by position")
    a = OrderedRows(left, [], order_left, rows_per_bucket).row_number("row_id").result()
    b = OrderedRows(right, [], order_right, rows_per_bucket).row_number("row_id").result()
    return a.join(b, "row_id")


def enrich(
    target: DataFrame,
    source: DataFrame,
    col: str,
    key_sets: list[list[str]] | None = None,
    order_target: list | None = None,
    order_source: list | None = None,
) -> DataFrame:
    """Copy ``col`` from ``source``: by position if orders are given and lengths agree, else by keys.

    The first key set present on both sides is used; null keys match null keys; a key with two
    values of ``col`` is an error. The join strategy follows the measured sizes.
    """
    if col not in source.columns:
        raise ValueError(f"'{col}' is not a column of the source")
    if order_target and order_source and target.count() == source.count():
        only = source.select(*[F.col(c).alias(f"__s{i}") if isinstance(c, str) else c.alias(f"__s{i}")
                               for i, c in enumerate(order_source)], F.col(q(col)).alias("__value"))
        sides = align_by_position(
            target.drop(col), only, order_target, [f"__s{i}" for i in range(len(order_source))]
        )
        return sides.select(*[F.col(q(c)) for c in target.columns if c != col], F.col("__value").alias(col))
    for keys in key_sets or KEY_SETS:
        if all(k in source.columns and k in target.columns for k in keys):
            lookup = source.select(
                *[F.col(q(k)).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(q(col)).alias("__value")
            ).distinct()
            lookup = cut(lookup)
            names = [f"__k{i}" for i in range(len(keys))]
            if not lookup.groupBy(*names).count().where("count > 1").isEmpty():
                raise ValueError(f"keys {keys} are not unique in the source")
            on = reduce(
                lambda x, y: x & y, [F.col(q(k)).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
            )
            joined = target.drop(col).join(small(lookup), on, "left")
            return joined.select(*[F.col(q(c)) for c in target.columns if c != col], F.col("__value").alias(col))
    raise RuntimeError("lengths differ and no usable key set was found")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_ids(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))
