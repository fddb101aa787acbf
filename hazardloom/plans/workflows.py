"""The chains a user runs end to end, each a composition of operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import (
    features,
    models,
    pareto,
    quality,
    report,
    rollup,
    rules,
    scenarios,
    schema,
    sequences,
    stability,
    text,
)
from ..session import cut


class StateStatistics(NamedTuple):
    top_states: DataFrame
    mapping: DataFrame
    percentages: DataFrame


class TextResult(NamedTuple):
    rows: DataFrame
    missing: list[str]
    quality: DataFrame
    top_tokens: DataFrame
    lengths: DataFrame


class FusionResult(NamedTuple):
    scenarios: DataFrame
    classes: DataFrame
    class_counts: DataFrame
    class_a: DataFrame


class SensitivityResult(NamedTuple):
    metrics: DataFrame
    matrix: DataFrame
    trajectories: DataFrame


class ClassifierResult(NamedTuple):
    model: object
    report: DataFrame
    importances: DataFrame
    mapping: DataFrame


def state_statistics(
    df: DataFrame, state: str = "State Name", code: str = "Accident Type Code", label: str = "Accident Type", top: int = 10
) -> StateStatistics:
    """Largest states, code mapping and the share of each type inside each state."""
    return StateStatistics(
        rollup.top_groups(df, state, top),
        rollup.code_mapping(df, code, label),
        rollup.percent_crosstab(df, state, code),
    )


def text_workflow(
    df: DataFrame,
    columns: list[str] | None = None,
    merge: list[str] | None = None,
    cleaner=tx.clean_text,
    options: dict | None = None,
) -> TextResult:
    """Core columns, their cleaned copies, the merged text and its profile.

    ``merge`` lists the columns whose cleaned text is joined.
    """
    core, missing = schema.select_core(df, columns)
    cleaned = text.clean_columns(core, core.columns, cleaner=cleaner, options=options)
    wanted = merge or ["Primary Accident Cause", "Contributing Accident Cause", "Accident Type"]
    rows = text.merge_text(cleaned, [f"{c}_clean" for c in wanted])
    return TextResult(
        rows,
        missing,
        text.text_quality(rows, "text_merged"),
        text.top_tokens(rows, "text_merged", 10),
        text.length_histogram(rows, "text_merged", 50),
    )


def find_scenarios(
    df: DataFrame, cols: list[str], target: str, by: list[str] | None = None, min_support: float = 0.01, max_len: int = 3
) -> DataFrame:
    """High-risk condition combinations with positive uplift."""
    return quality.filter_positive(rules.risk_combinations(df, cols, target, min_support, max_len, by), "uplift")


def fuse_and_classify(
    found: DataFrame, imp: DataFrame, w1: float = 0.5, w2: float = 0.5, by: list[str] | None = None
) -> FusionResult:
    """Scenario importance, composite index, Pareto classes and the class-A list."""
    scored = cut(scenarios.scenario_importance(found, imp, by))
    classes = cut(pareto.pareto(scenarios.cri(scored, w1, w2, by), by=by))
    return FusionResult(scored, classes, pareto.class_counts(classes, by), pareto.class_a(classes))


def learned_classes(found: DataFrame, imp: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """Pareto classes on the learned index; negative predictions count as 0."""
    seq = sequences.sequences(found, imp, by=by, match="condition", label=sequences.weak_label("lift"))
    keys = [*(by or []), "scenario_id"]
    learned = sequences.learned_cri(seq, by, **options).select(*keys, "CRI_Learned")
    return pareto.pareto(cut(found.join(learned, keys)), "CRI_Learned", by, clamp=True)


def sensitivity(scored: DataFrame, weights: list[tuple[float, float]] | None = None, state: str = "state") -> SensitivityResult:
    """Class-A lists under every weight pair and how far their ranking moves."""
    swept = scenarios.weight_sweep(scored, weights, [state])
    listed = cut(pareto.pareto(swept, by=[state, "w1", "w2"]).where("Class = 'A'"))
    metrics = cut(stability.stability(listed, state=state))
    return SensitivityResult(metrics, stability.stability_matrix(metrics), stability.rank_trajectory(listed, state=state))


def deep_dive(classes: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scenarios per type, best scenarios of the leading types, and their narratives."""
    listed = classes.where(F.col("Class") == "A")
    return report.scenarios_per_type(listed, by), report.top_per_type(listed, by=by), report.narratives(listed, by=by)


def classifier(
    df: DataFrame, key: list[str], target: str, numeric: list[str], categorical: list[str], vectors: DataFrame | None = None,
    **options,
) -> ClassifierResult:
    """Prepare, add text vectors, split by class, fit boosted trees, evaluate, list importances.

    ``vectors`` holds the single key column as ``row_id`` and a vector column ``text_features``.
    """
    rows = quality.drop_null_target(df, target)
    prepared, names = features.preprocess(rows, numeric, categorical, out="baseline")
    if vectors is not None:
        prepared = prepared.join(vectors.withColumnRenamed("row_id", key[0]), key[:1])
        prepared = features.assemble(prepared, ["baseline", "text_features"])
    else:
        prepared = prepared.withColumnRenamed("baseline", "features")
    labelled, mapping = features.encode_label(prepared, target)
    marked = cut(features.stratified_split(labelled, target, key).select("features", "label", "is_test"))
    model = models.train_boosted(marked.where(~F.col("is_test")), **options)
    classes = [r["class"] for r in mapping.orderBy("code").collect()]
    tested = models.predict(model, marked.where("is_test"))
    return ClassifierResult(
        model,
        models.classification_report(tested, names=classes),
        models.importance_table(df.sparkSession, model, names),
        mapping,
    )
