"""Ranking and ABC classes of scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import OrderedRows
from .sizing import match, measured

A_LIMIT, B_LIMIT = 0.80, 0.90


def rank_scenarios(
    df: DataFrame, by: list[str], score: str = "CRI_Score", key: str = "scenario_id", out: str = "Rank",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """1-based rank by descending score inside each configuration, ties by key."""
    return OrderedRows(df, by, [-F.col(score), F.col(key)], rows_per_bucket).row_number(out).result()


def running_share(
    df: DataFrame, score: str = "CRI_Score", by: list[str] | None = None, key: str = "scenario_id",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """``cumulative_score`` and ``cumulative_percentage`` from the highest score down."""
    by = list(by or [])
    ordered = OrderedRows(df, by, [-F.col(score), F.col(key)], rows_per_bucket)
    totals = ordered.stored.groupBy(*by).agg(F.sum(score).alias("__total"))
    running = ordered.running_sum(score, "cumulative_score").result()
    if by:
        running = match(running, measured(totals), by)
    else:
        running = running.withColumn("__total", totals.scalar())
    return running.withColumn("cumulative_percentage", F.try_divide("cumulative_score", "__total")).drop("__total")


def abc_class(share, a: float = A_LIMIT, b: float = B_LIMIT) -> Column:
    c = share if isinstance(share, Column) else F.col(share)
    return F.when(c <= a, "A").when(c <= b, "B").otherwise("C")


def pareto(
    df: DataFrame, score: str = "CRI_Score", by: list[str] | None = None, a: float = A_LIMIT, b: float = B_LIMIT,
    clamp: bool = False, key: str = "scenario_id", rows_per_bucket: int | None = None,
) -> DataFrame:
    """Running share and ``Class``; ``clamp`` counts negative scores as 0 so the share never falls."""
    if clamp:
        df = df.withColumn(score, F.greatest(F.col(score), F.lit(0.0)))
    shared = running_share(df, score, by, key, rows_per_bucket)
    return shared.withColumn("Class", abc_class("cumulative_percentage", a, b))


def class_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scenarios per class and their share of all scenarios of the group."""
    by = list(by or [])
    counts = df.groupBy(*by, "Class").agg(F.count(F.lit(1)).alias("n"))
    if by:
        out = match(counts, counts.groupBy(*by).agg(F.sum("n").alias("__all")), by)
    else:
        out = counts.withColumn("__all", counts.agg(F.sum("n")).scalar())
    return out.withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def class_a(df: DataFrame) -> DataFrame:
    """Class-A scenarios with the report columns that exist."""
    wanted = ["state", "model_version", "w1", "w2", "Class", "accident_type", "evidence", "scenario_id", "uplift",
              "s2_2_importance", "CRI_Score", "matched_details"]
    return df.where(F.col("Class") == "A").select(*[c for c in wanted if c in df.columns])
