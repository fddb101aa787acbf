"""Cleaning and profiling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_blank
from ..functions.values import safe_corr
from .quantiles import exact_quantiles, rank_statistics, value_counts
from .schema import missing_names, q, split_types


def _null(c: str) -> Column:
    return F.col(q(c)).isNull()


def _long(wide: DataFrame, names: list[str], label: str, value: str) -> DataFrame:
    """Columns c0, c1, … of a one-row frame as ``(label, value)`` rows."""
    pairs = [F.struct(F.lit(n).alias(label), F.col(f"c{i}").alias(value)) for i, n in enumerate(names)]
    return wide.select(F.inline(F.array(*pairs)))


def clean_initial(df: DataFrame) -> DataFrame:
    """Drop all-null rows, then all-null columns, then duplicate rows (null equals null)."""
    rows = df.na.drop(how="all")
    filled = rows.agg(*[F.count(F.col(q(c))).alias(f"c{i}") for i, c in enumerate(rows.columns)]).first()
    empty = [c for i, c in enumerate(rows.columns) if filled[f"c{i}"] == 0]
    return rows.drop(*empty).dropDuplicates()


def filter_positive(df: DataFrame, col: str = "uplift") -> DataFrame:
    return df.where(F.col(q(col)) > 0)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def filter_non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(~is_blank(F.col(q(col)).cast("string")))


def count_where(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows satisfy each named condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def null_ratios(df: DataFrame) -> DataFrame:
    """``(column, null_ratio)`` for every column in one pass."""
    wide = df.agg(*[F.avg(_null(c).cast("double")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return _long(wide, df.columns, "column", "null_ratio")


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row ``duplicate_rows``: rows beyond the first of each group of equal rows."""
    copies = df.groupBy(*[F.col(q(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return copies.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """``(section, column, metric, value)``: shape, nulls per column, duplicates, types."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_null(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    entries = [("shape", None, "rows", F.col("rows")), ("shape", None, "columns", F.lit(len(df.columns)))]
    entries += [("missing_values", c, "nulls", F.col(f"c{i}")) for i, c in enumerate(df.columns)]
    entries += [("data_types", f.name, "type", F.lit(f.dataType.simpleString())) for f in df.schema.fields]

    def rows(frame: DataFrame, items: list) -> DataFrame:
        return frame.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(s).alias("section"),
                            F.lit(c).cast("string").alias("column"),
                            F.lit(m).alias("metric"),
                            v.cast("string").alias("value"),
                        )
                        for s, c, m, v in items
                    ]
                )
            )
        )

    repeated = rows(duplicate_count(df), [("duplicates", None, "duplicate_rows", F.col("duplicate_rows"))])
    return rows(wide, entries).unionByName(repeated)


def validate(df: DataFrame, required: list[str] | None = None, null_limit: float = 0.5) -> DataFrame:
    """Findings as ``(severity, check, detail)``; the table is valid when no 'issue' is among them."""
    spark = df.sparkSession
    known = [("issue", "missing_column", name) for name in missing_names(df, required or [])]
    if not split_types(df)[0]:
        known.append(("warning", "no_numeric_column", ""))
    findings = spark.createDataFrame(known, "severity string, check string, detail string")
    sparse = null_ratios(df).where(F.col("null_ratio") > null_limit)
    copies = duplicate_count(df).where("duplicate_rows > 0")
    for frame, check, detail in (
        (sparse, "high_null_column", F.col("column")),
        (copies, "duplicate_rows", F.col("duplicate_rows").cast("string")),
    ):
        findings = findings.unionByName(
            frame.select(F.lit("warning").alias("severity"), F.lit(check).alias("check"), detail.alias("detail"))
        )
    return findings


def is_valid(findings: DataFrame) -> bool:
    return findings.where("severity = 'issue'").isEmpty()


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Describe per numeric column: count, mean, std, min, exact quartiles, max; two passes."""
    cols = cols if cols is not None else split_types(df)[0]
    quarters = [0.25, 0.5, 0.75]
    basic = ("count", "mean", "std", "min", "max")
    stats = df.agg(
        *[
            F.struct(
                F.count(F.col(q(c))).alias("count"),
                F.avg(F.col(q(c))).alias("mean"),
                F.stddev_samp(F.col(q(c))).alias("std"),
                F.min(F.col(q(c))).cast("double").alias("min"),
                F.max(F.col(q(c))).cast("double").alias("max"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ],
        *rank_statistics(df, cols, quarters),
    ).first()
    placed = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, cols, quarters, stats=stats).collect()}
    rows = [
        (c, *[stats[f"c{i}"][b] for b in basic[:4]], *[placed.get((c, p)) for p in quarters], stats[f"c{i}"]["max"])
        for i, c in enumerate(cols)
    ]
    schema = "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    return df.sparkSession.createDataFrame(rows, schema)


def categorical_summary(df: DataFrame, cols: list[str] | None = None, top: int = 5) -> DataFrame:
    """Per text column: distinct values, most frequent value, and its ``top`` values by count.

    The ranking window runs over value counts; its row limit is applied before the shuffle.
    """
    cols = cols if cols is not None else split_types(df)[1]
    counts = value_counts(df, cols)
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("position", F.row_number().over(by_count)).where(F.col("position") <= top)
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return ranked.join(totals, "column").select(
        "column", "unique_count", "position", "value", F.col("n").alias("frequency")
    )


def summary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numeric and categorical summary."""
    return numeric_summary(df), categorical_summary(df)


def correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(a, b, corr)``: the full Pearson matrix, nulls left out per pair, one pass for all pairs."""
    cols = cols if cols is not None else split_types(df)[0]
    pairs = [(a, a) for a in cols] + list(combinations(cols, 2))
    x = {c: F.col(q(c)).cast("double") for c in cols}
    wide = df.agg(*[safe_corr(x[a], x[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"c{i}").alias("corr")))
    return wide.select(F.inline(F.array(*cells)))
