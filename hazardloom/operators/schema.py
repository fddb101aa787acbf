"""Operators that decide by column names and types; only metadata reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.evidence import parse_evidence
from ..functions.values import lenient_number, plain_text

# The core columns of an incident table.
CORE_COLUMNS = [
    "Date",
    "Time",
    "Accident Type",
    "Temperature",
    "Visibility",
    "Weather Condition",
    "Equipment Type",
    "Equipment Attended",
    "Train Speed",
    "Recorded Estimated Speed",
    "Signalization",
    "Method of Operation",
    "Adjunct Name 1",
    "Positive Alcohol Tests",
    "Positive Drug Tests",
    "Primary Accident Cause",
    "Contributing Accident Cause",
]

# Columns with too many distinct values for one-hot encoding.
HIGH_CARDINALITY_COLUMNS = [
    "date",
    "milepost",
    "trainnumber",
    "location",
    "station",
    "maintenancerailroadcode",
    "subdivision",
    "time",
    "trackdensity",
    "trackname",
]

# Identifier columns that never become conditions.
IDENTIFIER_COLUMNS = [
    "AccidentId",
    "ReportYear",
    "Accident Number",
    "Report Number",
    "ID",
    "id",
    "index",
]


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def split_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of numeric and of text columns; booleans and dates are neither."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def normalized_name(name: str) -> str:
    return " ".join(name.split()).lower()


def select_core(df: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Columns matching ``names`` up to case and blanks, plus the names without a match."""
    actual = {normalized_name(c): c for c in df.columns}
    wanted = names or CORE_COLUMNS
    found = [actual[normalized_name(n)] for n in wanted if normalized_name(n) in actual]
    missing = [n for n in wanted if normalized_name(n) not in actual]
    return df.select(*[F.col(q(c)) for c in found]), missing


def missing_names(df: DataFrame, required: list[str]) -> list[str]:
    """Required minus present columns, in the order asked for."""
    present = set(df.columns)
    return [n for n in required if n not in present]


def keep_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Listed columns in list order, plus the listed names the table lacks."""
    missing = missing_names(df, names)
    return df.select(*[F.col(q(n)) for n in names if n not in missing]), missing


def zero_variance_columns(df: DataFrame) -> list[str]:
    """Columns with exactly one distinct non-null value: their minimum equals their maximum.

    Minimum and maximum combine before the shuffle, so no value set is ever built.
    """
    seen = df.agg(
        *[(F.min(F.col(q(c))) == F.max(F.col(q(c)))).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    return [c for i, c in enumerate(df.columns) if seen[f"c{i}"]]


def drop_zero_variance(df: DataFrame) -> DataFrame:
    return df.drop(*zero_variance_columns(df))


def distinct_counts(df: DataFrame, names: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """``(column, n_distinct)``, nulls not counted, largest first."""
    cols = names if names is not None else df.columns
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(F.col(q(c))).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_distinct")) for i, c in enumerate(cols)]
    )
    return wide.select(F.inline(pairs)).orderBy(F.desc("n_distinct"), "column")


def drop_columns_report(
    df: DataFrame, names: list[str] | None = None, threshold: int | None = None, approximate: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Drop the listed columns, report distinct counts of the others.

    With ``threshold``, text columns above it are dropped as well.
    """
    kept = df.drop(*(names if names is not None else HIGH_CARDINALITY_COLUMNS))
    counts = distinct_counts(kept, approximate=approximate)
    if threshold is not None:
        _, text = split_types(kept)
        over = counts.where((F.col("n_distinct") > threshold) & F.col("column").isin(text)).collect()
        kept = kept.drop(*[r["column"] for r in over])
        counts = counts.where(F.col("column").isin(kept.columns))
    return kept, counts


def as_categorical(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Every column as text, identifiers untouched."""
    skip = set(exclude if exclude is not None else IDENTIFIER_COLUMNS)
    return df.select(
        *[
            F.col(q(f.name)) if f.name in skip else plain_text(f.name, f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def _first_present(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def canonical_scenarios(df: DataFrame) -> DataFrame:
    """Scenario table under its canonical names; absent numbers become 0."""
    variants = {
        "accident_type": ["accident_type", "Accident Type"],
        "evidence": ["evidence", "evidence_dict"],
        "prob": ["prob", "P", "confidence"],
        "lift": ["lift", "Lift", "uplift"],
        "support_rate": ["support_prob", "support_rate", "support"],
        "uplift": ["uplift"],
    }
    found = {name: _first_present(df, options) for name, options in variants.items()}
    if found["evidence"] is None:
        raise ValueError("the scenario table has no evidence column")
    used = set(found.values())
    columns = []
    for name, source in found.items():
        if name == "evidence":
            is_text = isinstance(df.schema[source].dataType, T.StringType)
            columns.append((parse_evidence(source) if is_text else F.col(q(source))).alias(name))
        elif name == "accident_type":
            columns.append((F.col(q(source)).cast("string") if source else F.lit("Unknown")).alias(name))
        elif source is not None:
            columns.append(lenient_number(source).alias(name))
        elif name != "uplift":
            columns.append(F.lit(0.0).alias(name))
    rest = [F.col(q(c)) for c in df.columns if c not in used and c not in variants]
    return df.select(*columns, *rest)


def canonical_importances(df: DataFrame) -> DataFrame:
    """Importance table as ``(feature_name, importance_score)``."""
    pairs = [("feature", "importance"), ("feature_name", "importance_score"),
             ("Unnamed: 0", "importance_score"), ("_c0", "importance_score")]
    pair = next((p for p in pairs if p[0] in df.columns and p[1] in df.columns), None)
    if pair is None:
        if len(df.columns) < 2:
            raise ValueError("an importance table needs a feature and an importance column")
        pair = (df.columns[0], df.columns[1])
    return df.select(
        F.trim(F.col(q(pair[0])).cast("string")).alias("feature_name"),
        lenient_number(pair[1]).alias("importance_score"),
    )
