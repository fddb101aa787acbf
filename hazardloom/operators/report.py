"""Deep-dive tables and narratives per accident type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.evidence import evidence_label, evidence_text, scored_parts, sorted_entries

# The sentences of the narrative.
SCENE = "**场景 %d**："
PATTERN = "- **风险模式**：当 %s 时。"
CONDITION = "【%s 为 %s】"
JOINER = " 且 "
SUPPORT = "- **数据支撑**：该组合使事故概率提升了 %.1f%% (Uplift)。"
CAUSES = "- **核心致因**：模型识别出的高贡献特征包括："
CAUSE = "  * %s"
TRACK_ADVICE = "- **建议措施**：加强对相关轨道区段（如 %s）的几何尺寸与磨损检查。"
TRACK_DEFAULT = "该区域"
EQUIPMENT_ADVICE = "- **建议措施**：针对 %s 实施更严格的作业前检查或防溜措施。"
EQUIPMENT_DEFAULT = "车辆"


def scenarios_per_type(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), "accident_type").agg(F.count(F.lit(1)).alias("n"))


def top_per_type(
    df: DataFrame, n: int = 5, types: int = 4, by: list[str] | None = None, score: str = "CRI_Score"
) -> DataFrame:
    """Best ``n`` scenarios of each of the ``types`` most frequent accident types, with a label.

    Both windows keep a few rows per group; Spark applies the limits before the shuffle.
    """
    by = list(by or [])
    counts = scenarios_per_type(df, by)
    if by:
        common = Window.partitionBy(*by).orderBy(F.desc("n"), "accident_type")
        leading = counts.withColumn("__t", F.row_number().over(common)).where(F.col("__t") <= types)
    else:
        leading = counts.orderBy(F.desc("n"), "accident_type").limit(types)
    best = Window.partitionBy(*by, "accident_type").orderBy(F.desc(score), "scenario_id")
    return (
        df.join(leading.select(*by, "accident_type"), [*by, "accident_type"], "left_semi")
        .withColumn("position", F.row_number().over(best))
        .where(F.col("position") <= n)
        .withColumn("label", evidence_label("evidence"))
    )


def _advice(key: str, template: str, default: str) -> Column:
    return F.format_string(template, F.coalesce(F.try_element_at("evidence", F.lit(key)), F.lit(default)))


def narratives(df: DataFrame, n: int = 3, types: int = 4, by: list[str] | None = None) -> DataFrame:
    """One text per leading scenario: pattern, uplift, contributing features, advice."""
    pattern = F.array_join(
        F.transform(sorted_entries("evidence"), lambda e: F.format_string(CONDITION, e["key"], e["value"])), JOINER
    )
    causes = F.transform(scored_parts("matched_details"), lambda p: F.format_string(CAUSE, p))
    text = evidence_text("evidence")
    advice = F.when(
        F.contains(text, F.lit("Track")), _advice("Track Type", TRACK_ADVICE, TRACK_DEFAULT)
    ).when(F.contains(text, F.lit("Equipment")), _advice("Equipment Type", EQUIPMENT_ADVICE, EQUIPMENT_DEFAULT))
    lines = F.concat(
        F.array(
            F.format_string(SCENE, F.col("position")),
            F.format_string(PATTERN, pattern),
            F.format_string(SUPPORT, F.col("uplift") * 100),
            F.lit(CAUSES),
        ),
        causes,
        F.filter(F.array(advice), lambda a: a.isNotNull()),
    )
    return top_per_type(df, n, types, by).select(
        *(by or []), "accident_type", "position", "scenario_id", F.array_join(lines, "\n").alias("narrative")
    )
