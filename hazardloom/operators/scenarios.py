"""Scenario importance and the composite risk index (CRI)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import matched_part, sorted_entries
from ..functions.values import alnum_key, condition_key, feature_key
from .schema import q
from .sizing import match, measured, small

# The weight pairs (rules, model) of the sensitivity sweep and its baseline.
WEIGHTS = [(0.1, 0.9), (0.3, 0.7), (0.5, 0.5), (0.7, 0.3), (0.9, 0.1)]
BASELINE = (0.5, 0.5)
MATCH_RATE_FLOOR = 0.1


def conditions(scenarios: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per condition: ``by, scenario_id, pos, k, v`` in key order."""
    return scenarios.select(
        *(by or []), "scenario_id", F.posexplode(sorted_entries("evidence")).alias("pos", "e")
    ).select(*(by or []), "scenario_id", "pos", F.col("e.key").alias("k"), F.col("e.value").alias("v"))


def importance_lookup(imp: DataFrame, order: str | None = None) -> DataFrame:
    """``(feature, importance)`` by normalized key; of equal keys the last row counts.

    Importance lists are kept largest first, so without ``order`` the last one is the smallest.
    """
    keyed = imp.select("*", feature_key("feature_name").alias("feature"))
    last = F.max_by("importance_score", order) if order else F.min("importance_score")
    return keyed.groupBy("feature").agg(last.alias("importance"))


def lookup_two_tier(conds: DataFrame, imp: DataFrame, order: str | None = None) -> DataFrame:
    """Add ``tier`` and ``score``: the ``k_v`` entry (1), else the ``k`` entry (2), else 0."""
    lookup = small(importance_lookup(imp, order))
    pair = lookup.select(F.col("feature").alias("__pf"), F.col("importance").alias("__pi"))
    single = lookup.select(F.col("feature").alias("__kf"), F.col("importance").alias("__ki"))
    keyed = conds.withColumns(
        {"__pk": condition_key(F.concat("k", F.lit("_"), "v")), "__kk": condition_key("k")}
    )
    return (
        keyed.join(pair, F.col("__pk") == F.col("__pf"), "left")
        .join(single, F.col("__kk") == F.col("__kf"), "left")
        .withColumns(
            {
                "tier": F.when(F.col("__pf").isNotNull(), 1).when(F.col("__kf").isNotNull(), 2).otherwise(0),
                "score": F.coalesce("__pi", "__ki", F.lit(0.0)),
            }
        )
        .drop("__pk", "__kk", "__pf", "__pi", "__kf", "__ki")
    )


def lookup_three_tier(names: DataFrame, imp: DataFrame) -> DataFrame:
    """``(name, importance)``: raw name, else ``num__<key>``, else the best ``cat__<key>_…``, floor 0.

    A key holds letters and digits only, so "starts with ``cat__<key>_``" is the same as "the part
    between ``cat__`` and the next underscore equals the key": an equality join, not a prefix search.
    """
    entries = imp.select(F.trim("feature_name").alias("f"), F.col("importance_score").alias("s"))
    exact = small(entries.groupBy("f").agg(F.min("s").alias("s")))
    families = small(
        entries.where(F.rlike("f", F.lit("^cat__[^_]*_")))
        .groupBy(F.regexp_extract("f", "^cat__([^_]*)_", 1).alias("family"))
        .agg(F.greatest(F.max("s"), F.lit(0.0)).alias("best"))
    )
    keyed = names.select("name").distinct().withColumn("base", alnum_key("name"))
    raw = exact.select(F.col("f").alias("__r"), F.col("s").alias("__rs"))
    number = exact.select(F.col("f").alias("__n"), F.col("s").alias("__ns"))
    return (
        keyed.join(raw, F.trim("name") == F.col("__r"), "left")
        .join(number, F.concat(F.lit("num__"), F.col("base")) == F.col("__n"), "left")
        .join(families, F.col("base") == F.col("family"), "left")
        .select("name", F.coalesce("__rs", "__ns", "best", F.lit(0.0)).alias("importance"))
    )


def match_rate(looked_up: DataFrame, floor: float = MATCH_RATE_FLOOR, by: list[str] | None = None) -> DataFrame:
    """One row (per group): conditions processed, matched, rate, and whether the rate is suspiciously low."""
    rate = F.coalesce(F.try_divide(F.col("matched"), F.col("processed")), F.lit(0.0))
    return (
        looked_up.groupBy(*(by or []))
        .agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("tier") > 0).alias("matched"))
        .withColumn("match_rate", rate)
        .withColumn("low", F.col("match_rate") < floor)
    )


def matched_details(looked_up: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per scenario the mean score of its conditions and their text, in condition order."""
    part = matched_part(F.col("k"), F.col("v"), F.col("tier"), F.col("score"))
    # a scenario has at most one condition per column, so the list is short; adding in condition
    # order keeps the mean the same on every run
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"), "score")))
    grouped = looked_up.groupBy(*(by or []), "scenario_id").agg(parts.alias("__p"))
    total = F.aggregate("__p", F.lit(0.0), lambda acc, p: acc + p["score"])
    return grouped.select(
        *(by or []),
        "scenario_id",
        (total / F.size("__p")).alias("s2_2_importance"),
        F.array_join(F.transform("__p", lambda p: p["part"]), "; ").alias("matched_details"),
    )


def scenario_importance(
    scenarios: DataFrame, imp: DataFrame, by: list[str] | None = None, order: str | None = None
) -> DataFrame:
    """Add the mean importance of a scenario's conditions and the matched details.

    Conditions without a match count as 0; a scenario without conditions gets 0 and ''.
    """
    keys = [*(by or []), "scenario_id"]
    scored = matched_details(lookup_two_tier(conditions(scenarios, by), imp, order), by)
    return match(scenarios, scored, keys, "left").na.fill({"s2_2_importance": 0.0, "matched_details": ""})


def min_max(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``(x - min) / (max - min)`` over the set, null for a constant set."""
    return min_max_all(df, {col: out}, by)


def min_max_all(df: DataFrame, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """:func:`min_max` of several columns at once.

    All ranges come from one aggregation and one join, so a group of any size is never held at once.
    """
    sides = {
        f"__{x}{i}": f(F.col(q(c))) for i, c in enumerate(columns) for x, f in (("lo", F.min), ("hi", F.max))
    }
    ends = [agg.alias(name) for name, agg in sides.items()]
    if by:
        df = match(df, measured(df.groupBy(*by).agg(*ends)), by)
    else:
        df = df.withColumn("__r", df.agg(F.struct(*ends).alias("r")).scalar()).select("*", "__r.*").drop("__r")
    scaled = {
        out: F.try_divide(F.col(q(c)) - F.col(f"__lo{i}"), F.col(f"__hi{i}") - F.col(f"__lo{i}"))
        for i, (c, out) in enumerate(columns.items())
    }
    return df.withColumns(scaled).drop(*sides)


def normalized_scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``norm_uplift`` and ``norm_importance``; a constant column counts as 0 and is flagged."""
    out = min_max_all(df, {"uplift": "norm_uplift", "s2_2_importance": "norm_importance"}, by)
    return out.withColumn(
        "is_constant", F.col("norm_uplift").isNull() | F.col("norm_importance").isNull()
    ).na.fill(0.0, ["norm_uplift", "norm_importance"])


def cri(df: DataFrame, w1: float = 0.5, w2: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Composite index from uplift and importance, both scaled inside the ``by`` group."""
    return normalized_scores(df, by).withColumn(
        "CRI_Score", w1 * F.col("norm_uplift") + w2 * F.col("norm_importance")
    )


def weight_sweep(
    df: DataFrame, weights: list[tuple[float, float]] | None = None, by: list[str] | None = None
) -> DataFrame:
    """The index under every weight pair in one job: each scenario fans out into one row per pair."""
    pairs = F.array(
        *[F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2")) for a, b in (weights or WEIGHTS)]
    )
    return (
        normalized_scores(df, by)
        .select("*", F.inline(pairs))
        .withColumn("CRI_Score", F.col("w1") * F.col("norm_uplift") + F.col("w2") * F.col("norm_importance"))
    )
