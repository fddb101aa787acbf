"""Fusion of several score paths and priority ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import competition_rank
from .scenarios import min_max_all

# Configured weights of the score paths and of the ranking criteria.
PATH_WEIGHTS = {"association_score": 0.4, "model_score": 0.4, "confidence": 0.2}
CRITERIA_WEIGHTS = {"fused_score": 0.4, "confidence": 0.3, "frequency": 0.2, "impact": 0.1}
HIGH_LEVEL, MEDIUM_LEVEL = 0.7, 0.4


def _weighted(weights: dict[str, Column | float], value) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * value(c) for c, w in weights.items()])


def fuse_scores(
    df: DataFrame, paths: list[str] | None = None, method: str = "weighted_average",
    weights: dict[str, float] | None = None, by: list[str] | None = None, rows_per_bucket: int | None = None,
) -> DataFrame:
    """Scale every path to 0-1, combine them into ``fused_score`` and rank it.

    ``ensemble`` is the mean of weighted average, maximum and minimum; a constant path counts as 0.
    """
    weights = weights or PATH_WEIGHTS
    paths = paths or list(weights)
    df = min_max_all(df, {p: f"__p{i}" for i, p in enumerate(paths)}, by)
    scaled = {p: F.coalesce(F.col(f"__p{i}"), F.lit(0.0)) for i, p in enumerate(paths)}
    average = _weighted({p: weights[p] for p in paths}, lambda p: scaled[p]) / float(sum(weights[p] for p in paths))
    largest = F.greatest(*scaled.values()) if len(paths) > 1 else scaled[paths[0]]
    smallest = F.least(*scaled.values()) if len(paths) > 1 else scaled[paths[0]]
    methods = {
        "weighted_average": average,
        "max": largest,
        "min": smallest,
        "ensemble": (average + largest + smallest) / 3,
    }
    if method not in methods:
        raise ValueError(f"unknown fusion method: {method}")
    fused = df.withColumn("fused_score", methods[method]).drop(*[f"__p{i}" for i in range(len(paths))])
    return competition_rank(fused, list(by or []), "fused_score", "rank", rows_per_bucket)


def risk_level(score) -> Column:
    c = score if isinstance(score, Column) else F.col(score)
    return F.when(c >= HIGH_LEVEL, "high").when(c >= MEDIUM_LEVEL, "medium").otherwise("low")


def rank_priority(
    df: DataFrame, method: str = "multi_criteria", weights: dict[str, float] | None = None,
    by: list[str] | None = None, rows_per_bucket: int | None = None,
) -> DataFrame:
    """``priority_score``, ``risk_level`` and ``priority_rank`` by score, by level or by criteria.

    Ranking by level gives every scenario of a level the same rank.
    """
    level = risk_level("fused_score")
    if method == "score_based":
        score = F.col("fused_score")
    elif method == "risk_level":
        score = F.when(level == "high", 3.0).when(level == "medium", 2.0).otherwise(1.0)
    elif method == "multi_criteria":
        score = _weighted(weights or CRITERIA_WEIGHTS, F.col)
    else:
        raise ValueError(f"unknown ranking method: {method}")
    scored = df.withColumn("priority_score", score).withColumn("risk_level", level)
    return competition_rank(scored, list(by or []), "priority_score", "priority_rank", rows_per_bucket)


def fuse_and_rank(df: DataFrame, fusion: str = "weighted_average", ranking: str = "multi_criteria", **options) -> DataFrame:
    """Fusion followed by priority ranking."""
    return rank_priority(fuse_scores(df, method=fusion, **options), ranking, by=options.get("by"))
