"""Broadcast only what was measured to be small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut

#: Most bytes of a broadcast table.
BROADCAST_BYTES = 16 << 20
_LEAST_ROW = 8


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and binaries as long as they are, nested values as their text."""
    fixed, varying = 8 * len(df.columns), []
    for field in df.schema.fields:
        x = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            varying.append(F.octet_length(x))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            varying.append(F.octet_length(F.to_json(F.struct(x.alias("v")))))
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), varying, F.lit(fixed))


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table's measured bytes are at most ``most``; stops reading where its rows alone exceed them."""
    head = df.limit(most // _LEAST_ROW + 1)
    return (head.agg(F.sum(row_bytes(head) + _LEAST_ROW)).first()[0] or 0) <= most


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if it measures at most ``most`` bytes; beyond that the shuffle join stays.

    Meant for materialized or directly read tables, where measuring up to the limit is cheap.
    """
    return F.broadcast(df) if fits(df, most) else df


def measured(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Store a table aggregated from the large side and broadcast it if it turned out small.

    Without the measurement both join sides start to shuffle at once, and the large side has
    crossed the network before the small one is known to fit.
    """
    return small(cut(df), most)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, so a missing group is a group like any other."""
    if not keys:
        raise ValueError("a join needs keys")
    names = [f"__m{i}" for i in range(len(keys))]
    renamed = right.withColumnsRenamed(dict(zip(keys, names)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return left.join(renamed, on, how).drop(*names)
