"""Scenario token sequences and the learned risk index."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import sorted_entries
from ..functions.values import as_column
from .features import split
from .ordered import OrderedRows
from .scenarios import lookup_three_tier, lookup_two_tier

PAD_ID, UNKNOWN_ID = 0, 1
NUMERICS = ["prob", "lift", "support_rate", "importance"]


def token_rows(scenarios: DataFrame, by: list[str] | None = None, prefix: str = "AccidentType=") -> DataFrame:
    """``by, scenario_id, pos, token, k, v``: the type token first, then ``k=v`` in key order."""
    none = F.lit(None).cast("string")
    head = F.struct(F.concat(F.lit(prefix), F.col("accident_type")).alias("token"), none.alias("k"), none.alias("v"))
    rest = F.transform(
        sorted_entries("evidence"),
        lambda e: F.struct(F.concat(e["key"], F.lit("="), e["value"]).alias("token"), e["key"].alias("k"), e["value"].alias("v")),
    )
    return scenarios.select(
        *(by or []), "scenario_id", F.posexplode(F.concat(F.array(head), rest)).alias("pos", "t")
    ).select(*(by or []), "scenario_id", "pos", "t.token", "t.k", "t.v")


def vocabulary(tokens: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """``(token, token_id)``: padding 0, unknown 1, then the tokens in alphabetical order."""
    distinct = tokens.select("token").distinct()
    numbered = OrderedRows(distinct, [], ["token"], rows_per_bucket).row_number("__rn").result()
    fixed = tokens.sparkSession.createDataFrame(
        [("<PAD>", PAD_ID), ("<UNK>", UNKNOWN_ID)], "token string, token_id int"
    )
    return fixed.unionByName(numbered.select("token", (F.col("__rn") + UNKNOWN_ID).cast("int").alias("token_id")))


def _importances(tokens: DataFrame, imp: DataFrame, match: str) -> DataFrame:
    if match == "column":
        scores = lookup_three_tier(tokens.where("k is not null").select(F.col("k").alias("name")), imp)
        joined = tokens.join(scores, tokens["k"] == scores["name"], "left").drop("name")
        return joined.withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    scored = lookup_two_tier(tokens.where("k is not null"), imp).withColumnRenamed("score", "importance").drop("tier")
    return scored.unionByName(tokens.where("k is null").withColumn("importance", F.lit(0.0)))


def sequences(
    scenarios: DataFrame, imp: DataFrame, vocab: DataFrame | None = None, length: int = 10, by: list[str] | None = None,
    prefix: str = "AccidentType=", match: str = "column", label: Column | None = None,
) -> DataFrame:
    """``by, scenario_id, token_ids, mask, numeric, label`` with ``length`` positions per scenario.

    Every position holds ``[prob, lift, support_rate, importance]``; padding holds zeros. ``match``
    looks importances up by column name ('column') or by condition ('condition').
    """
    if length <= 0:
        raise ValueError("length must be positive")
    by = list(by or [])
    tokens = token_rows(scenarios, by, prefix)
    vocab = vocab if vocab is not None else vocabulary(tokens)
    ids = vocab.select("token", "token_id")
    placed = _importances(tokens.where(F.col("pos") < length), imp, match).join(ids, "token", "left")
    entry = F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id"), "importance")
    # at most `length` entries per scenario
    grouped = placed.groupBy(*by, "scenario_id").agg(F.array_sort(F.collect_list(entry)).alias("__t"))
    numbers = [F.col(c).cast("double") for c in NUMERICS[:3]]
    joined = scenarios.join(grouped, [*by, "scenario_id"])
    gap = F.lit(length) - F.size("__t")
    zeros = F.array(*[F.lit(0.0)] * len(NUMERICS))
    return joined.select(
        *by,
        "scenario_id",
        F.concat(F.transform("__t", lambda t: t["id"]), F.array_repeat(F.lit(PAD_ID), gap)).alias("token_ids"),
        F.concat(F.transform("__t", lambda t: F.lit(True)), F.array_repeat(F.lit(False), gap)).alias("mask"),
        F.concat(
            F.transform("__t", lambda t: F.array(*numbers, t["importance"])), F.array_repeat(zeros, gap)
        ).alias("numeric"),
        (label if label is not None else weak_label("prob")).alias("label"),
    )


def weak_label(kind: str = "prob", transform: str = "none") -> Column:
    """Training target from prob, lift or uplift, optionally log1p of the value clipped above -1."""
    if kind not in ("prob", "lift", "uplift"):
        raise ValueError("label must be 'prob', 'lift' or 'uplift'")
    if transform not in ("none", "log1p"):
        raise ValueError("transform must be 'none' or 'log1p'")
    value = as_column(kind).cast("double")
    return F.log1p(F.greatest(value, F.lit(-0.999999))) if transform == "log1p" else value


def token_statistics(seq: DataFrame, train: Column | None = None, padded: bool = False) -> DataFrame:
    """``(feature, mean, std)`` over the real tokens of the training rows (deviation floor 1e-6)."""
    rows = seq if train is None else seq.where(train)
    tokens = rows.select(F.explode(F.arrays_zip("mask", "numeric")).alias("t")).select("t.mask", "t.numeric")
    tokens = tokens if padded else tokens.where("mask")
    wide = tokens.agg(
        *[F.avg(F.get("numeric", F.lit(i))).alias(f"m{i}") for i in range(len(NUMERICS))],
        *[F.stddev_samp(F.get("numeric", F.lit(i))).alias(f"s{i}") for i in range(len(NUMERICS))],
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("feature"),
                        F.col(f"m{i}").alias("mean"),
                        F.greatest(F.coalesce(f"s{i}", F.lit(0.0)), F.lit(1e-6)).alias("std"),
                    )
                    for i, n in enumerate(NUMERICS)
                ]
            )
        )
    )


def standardize_tokens(seq: DataFrame, train: Column | None = None, padded: bool = False) -> DataFrame:
    """Token numerics as ``(x - mean) / std``; the eight statistics travel as literals."""
    stats = {r["feature"]: (r["mean"], r["std"]) for r in token_statistics(seq, train, padded).collect()}
    scale = [stats[n] for n in NUMERICS]
    return seq.withColumn(
        "numeric",
        F.transform(
            "numeric", lambda x: F.array(*[(F.get(x, F.lit(i)) - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(scale)])
        ),
    )


def pooled_features(seq: DataFrame, buckets: int = 128, leave_out: str | None = None) -> DataFrame:
    """Mean of the real tokens' numerics plus hashed tokens, as one vector per scenario."""
    used = [i for i, n in enumerate(NUMERICS) if n != leave_out]
    real = F.size(F.filter("mask", lambda m: m)).cast("double")
    both = F.arrays_zip("mask", "numeric")

    def mean(i: int) -> Column:
        tokens = F.filter(both, lambda t: t["mask"])
        total = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.get(t["numeric"], F.lit(i)))
        return total / F.greatest(real, F.lit(1.0))

    means = {f"__f{i}": mean(i) for i in used}
    words = F.transform(F.filter("token_ids", lambda t: t != PAD_ID), lambda t: t.cast("string"))
    rows = seq.withColumns({**means, "__words": words})
    hashed = HashingTF(inputCol="__words", outputCol="__hashed", numFeatures=buckets).transform(rows)
    vector = VectorAssembler(inputCols=[*means, "__hashed"], outputCol="features").transform(hashed)
    return vector.drop("__words", "__hashed", *means)


def learned_cri(
    seq: DataFrame, by: list[str] | None = None, ratio: float = 0.2, seed: int = 42, trees: int = 50, depth: int = 5,
    leave_out: str | None = None, buckets: int = 128, out: str = "CRI_Learned",
) -> DataFrame:
    """Boosted regression of the weak label on pooled sequence features, stopped early on a
    held-out part; every scenario gets a prediction. ``leave_out`` hides the label's own input.
    """
    key = [*(by or []), "scenario_id"]
    marked = split(seq, key, ratio, seed)
    scaled = standardize_tokens(marked, ~F.col("is_validation"))
    vectors = pooled_features(scaled, buckets, leave_out)
    learner = GBTRegressor(
        featuresCol="features", labelCol="label", predictionCol=out, maxIter=trees, maxDepth=depth, seed=seed,
        validationIndicatorCol="is_validation" if ratio > 0 else None,
    )
    return learner.fit(vectors).transform(vectors).select(*key, "label", "is_validation", out)
