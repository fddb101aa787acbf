"""Exact quantiles, value counts and modes without holding a column in one task."""

from __future__ import annotations

from math import floor, isinf

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .ordered import distinct_running
from .schema import q

ACCURACY = 20_000
_SETS_AT_ONCE = 60


def counts_per_column(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(series, value, n)``: how often each non-null value occurs in each named expression.

    One pass with one grouping set per expression, combined before the shuffle. All expressions
    must have the same type.
    """
    names = list(columns)
    out = None
    for start in range(0, len(names), _SETS_AT_ONCE):
        some = names[start : start + _SETS_AT_ONCE]
        slots = [f"__c{i}" for i in range(len(some))]
        rows = df.select(*[columns[n].alias(s) for n, s in zip(some, slots)])
        counted = rows.groupingSets([[s] for s in slots], *slots).agg(
            F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("n")
        )
        # in the set of one column every other column's bit is raised
        full = (1 << len(slots)) - 1
        by_id = F.create_map(
            *[x for i, n in enumerate(some) for x in (F.lit(full - (1 << (len(slots) - 1 - i))), F.lit(n))]
        ).cast("map<bigint,string>")
        value = F.coalesce(*slots)
        part = counted.where(value.isNotNull()).select(
            F.element_at(by_id, F.col("__g").cast("bigint")).alias("series"), value.alias("value"), "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _numbers(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """The columns as doubles, NaN as null."""
    out = {}
    for c in cols:
        x = F.col(q(c)).cast("double")
        out[c] = F.when(~F.isnan(x), x)
    return out


def rank_statistics(df: DataFrame, cols: list[str], probs: list[float]) -> list[Column]:
    """Aggregates that :func:`exact_quantiles` needs first; add them to a pass that runs anyway."""
    slack = 4.0 / ACCURACY
    asked = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    numbers = _numbers(df, cols)
    return [
        aggregate
        for i, c in enumerate(cols)
        for aggregate in (
            F.count(numbers[c]).alias(f"__n{i}"),
            F.percentile_approx(numbers[c], asked, ACCURACY).alias(f"__q{i}"),
        )
    ]


def _placed(df: DataFrame, series: dict[str, Column], wanted: list[tuple], rows_per_bucket: int | None) -> list:
    """The values on both sides of every wanted rank: ``(name, prob, place, lo, hi)``."""
    counted = cut(counts_per_column(df, series))
    running = distinct_running(counted, ["series"], "value", "n", rows_per_bucket)
    ranks = df.sparkSession.createDataFrame(wanted, "series string, prob double, place double")
    # the list of wanted ranks has columns x probs rows
    joined = running.join(F.broadcast(ranks), "series")
    before = F.col("upto") - F.col("n")

    def holds(rank: Column) -> Column:
        return (before <= rank) & (rank < F.col("upto"))

    low, high = F.floor("place"), F.ceil("place")
    return (
        joined.where(holds(low) | holds(high))
        .groupBy("series", "prob", "place")
        .agg(
            F.max(F.when(holds(low), F.col("value"))).alias("lo"),
            F.max(F.when(holds(high), F.col("value"))).alias("hi"),
        )
        .collect()
    )


def values_at(df: DataFrame, series: dict[str, Column], ranks: list[int]) -> dict[str, list[float]]:
    """Of each expression the values at these places (from 0) among its ordered non-null values.

    Values are counted first; places beyond the last value are left out.
    """
    wanted = [(name, float(r), float(r)) for name in series for r in ranks]
    out: dict[str, list[float]] = {}
    for row in sorted(_placed(df, series, wanted, None), key=lambda r: r["place"]):
        out.setdefault(row["series"], []).append(row["lo"])
    return out


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], rows_per_bucket=None, stats=None
) -> DataFrame:
    """``(column, prob, value)`` with linear interpolation between neighbours, nulls ignored.

    Values are counted before they are ordered, so repeated values cost nothing. Approximate
    percentiles give a range around each target rank; all smaller values count as minus infinity
    and all larger ones as infinity, so only the values of the range are shuffled and ordered. A rank that then falls on an infinity was outside its range, and all values are
    ordered instead. The result has one row per column and probability.
    """
    if stats is None:
        stats = df.agg(*rank_statistics(df, cols, probs)).first()
    counts = {c: stats[f"__n{i}"] for i, c in enumerate(cols)}
    numbers = {c: x for c, x in _numbers(df, cols).items() if counts[c]}
    found = None
    if numbers:
        series, wanted = {}, []
        for i, c in enumerate(cols):
            for j, p in enumerate(probs):
                if counts[c]:
                    x, low, high = numbers[c], stats[f"__q{i}"][2 * j], stats[f"__q{i}"][2 * j + 1]
                    name = f"{p!r}/{c}"
                    series[name] = F.when(x < low, float("-inf")).when(x > high, float("inf")).otherwise(x)
                    wanted.append((name, float(p), float((counts[c] - 1) * p)))
        found = _placed(df, series, wanted, rows_per_bucket)
        if any(isinf(r["lo"]) or isinf(r["hi"]) for r in found):
            found = None
        else:
            found = [(r["series"].split("/", 1)[1], r["prob"], r["place"], r["lo"], r["hi"]) for r in found]
    if found is None and numbers:
        wanted = [(c, float(p), float((counts[c] - 1) * p)) for c in numbers for p in probs]
        found = [tuple(r) for r in _placed(df, numbers, wanted, rows_per_bucket)]
    rows = [
        (c, p, lo if lo == hi else lo + (hi - lo) * (place - floor(place))) for c, p, place, lo, hi in found or []
    ]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def medians(df: DataFrame, cols: list[str], stats=None) -> dict[str, float]:
    """Exact medians as a small driver-side map (one entry per column)."""
    if not cols:
        return {}
    return {r["column"]: r["value"] for r in exact_quantiles(df, cols, [0.5], stats=stats).collect()}


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, n)`` of non-null values as text."""
    counted = counts_per_column(df, {c: F.col(q(c)).cast("string") for c in cols})
    return counted.withColumnRenamed("series", "column")


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, n)``: the most frequent value, the smallest one on ties."""
    best = F.min(F.struct((-F.col("n")).alias("key"), F.col("value")))
    return (
        value_counts(df, cols)
        .groupBy("column")
        .agg(best.alias("m"))
        .select("column", F.col("m.value").alias("value"), (-F.col("m.key")).alias("n"))
    )
