"""Missing values: policies, advice, ordered fills, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import neighbours
from .ordered import OrderedRows
from .quality import null_ratios
from .quantiles import medians, modes, rank_statistics
from .schema import q, split_types

# Name patterns of special column families.
SPECIAL_PATTERNS = {
    "Railroad": ["Railroad Code", "Railroad Name"],
    "Location": ["State", "County", "City"],
    "Accident": ["Accident Type", "Cause"],
    "Equipment": ["Equipment Type", "Car Number"],
    "Time": ["Date", "Time", "Year", "Month"],
}

def _number_or(c: str, value: float) -> Column:
    return F.coalesce(F.col(q(c)).cast("double"), F.lit(float(value)))


def impute_policy(
    df: DataFrame, high: float = 0.95, numeric: float = 0.10, text: float = 0.20, placeholder: str = "UNKNOWN"
) -> tuple[DataFrame, DataFrame]:
    """Drop, median or placeholder by null ratio, plus ``(column, null_ratio, action, fill)``.

    One pass finds the ratios and brackets the medians, one finds the exact medians; the fill
    itself is row-wise.
    """
    every = split_types(df)[0]
    stats = df.agg(
        *[F.avg(F.col(q(c)).isNull().cast("double")).alias(f"r{i}") for i, c in enumerate(df.columns)],
        *rank_statistics(df, every, [0.5]),
    ).first()
    ratios = {c: stats[f"r{i}"] or 0.0 for i, c in enumerate(df.columns)}
    dropped = [c for c in df.columns if ratios[c] > high]
    numbers, texts = split_types(df.drop(*dropped))
    to_median = [c for c in numbers if 0 < ratios[c] <= numeric]
    to_text = [c for c in texts if 0 < ratios[c] <= text]
    picked = {f"__{x}{j}": stats[f"__{x}{every.index(c)}"] for j, c in enumerate(to_median) for x in "nq"}
    middle = medians(df, to_median, picked)
    filled = df.drop(*dropped).withColumns(
        {
            **{c: _number_or(c, middle[c]) for c in to_median},
            **{c: F.coalesce(F.col(q(c)), F.lit(placeholder)) for c in to_text},
        }
    )
    report = []
    for c in df.columns:
        if c in dropped:
            report.append((c, ratios[c], "drop", None))
        elif c in middle:
            report.append((c, ratios[c], "median", str(middle[c])))
        elif c in to_text:
            report.append((c, ratios[c], "placeholder", placeholder))
        elif ratios[c] > 0.5:
            report.append((c, ratios[c], "still_high", None))
        else:
            report.append((c, ratios[c], "keep", None))
    table = df.sparkSession.createDataFrame(
        report, "column string, null_ratio double, action string, fill string"
    )
    return filled, table


def suggest_strategies(df: DataFrame) -> DataFrame:
    """``(column, kind, null_ratio, strategy, category)``; a column may appear once per reason."""
    numbers, texts = split_types(df)
    r = F.col("null_ratio")
    high = F.when(r > 0.95, "drop")
    by_number = F.when((r > 0) & (r <= 0.10), "median_imputation").when(
        (r > 0.10) & (r <= 0.50), "advanced_imputation"
    )
    by_text = F.when((r > 0) & (r <= 0.20), "placeholder").when((r > 0.20) & (r <= 0.50), "mode_imputation")

    def reason(kind: str, applies: Column, strategy: Column, category: str | None = None) -> Column:
        entry = F.struct(
            F.lit(kind).alias("kind"), strategy.alias("strategy"), F.lit(category).cast("string").alias("category")
        )
        return F.when(applies & strategy.isNotNull(), entry)

    name = F.col("column")
    reasons = [
        reason("high_missing", F.lit(True), high),
        reason("numeric", name.isin(numbers), by_number),
        reason("text", name.isin(texts), by_text),
    ]
    for category, patterns in SPECIAL_PATTERNS.items():
        for pattern in patterns:
            hit = F.contains(F.lower(name), F.lit(pattern.lower())) & (r > 0)
            reasons.append(reason("special", hit, F.lit(f"{category}_specific"), category))
    return (
        null_ratios(df)
        .withColumn("s", F.explode(F.filter(F.array(*reasons), lambda s: s.isNotNull())))
        .select("column", "s.kind", "null_ratio", "s.strategy", "s.category")
    )


def advice(spark, high: float = 0.95, numeric: float = 0.10, text: float = 0.20, placeholder: str = "UNKNOWN") -> DataFrame:
    """``(position, applies_to, strategy, detail)``: the thresholds and column families of this module as rows."""
    rows = [
        ("all", "drop", f"null ratio above {high:.2f}"),
        ("numeric", "median_imputation", f"null ratio up to {numeric:.2f}"),
        ("text", "placeholder", f"{placeholder} up to a null ratio of {text:.2f}"),
        *[(family.lower(), f"{family}_specific", ", ".join(names)) for family, names in SPECIAL_PATTERNS.items()],
    ]
    numbered = [(i, *r) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(numbered, "position int, applies_to string, strategy string, detail string")


def impute_median_mode(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Exact median for numbers, most frequent value (smallest on ties) for categories.

    One pass finds the columns with gaps and brackets their medians; complete columns cost no more.
    """
    asked = [*numeric, *categorical]
    if not asked:
        return df
    stats = df.agg(
        *[F.max(F.col(q(c)).isNull()).alias(f"g{i}") for i, c in enumerate(asked)],
        *rank_statistics(df, numeric, [0.5]),
    ).first()
    gaps = {c for i, c in enumerate(asked) if stats[f"g{i}"]}
    numbers, texts = [c for c in numeric if c in gaps], [c for c in categorical if c in gaps]
    picked = {f"__{x}{j}": stats[f"__{x}{numeric.index(c)}"] for j, c in enumerate(numbers) for x in "nq"}
    middle = medians(df, numbers, picked)
    common = {r["column"]: r["value"] for r in modes(df, texts).collect()} if texts else {}
    return df.withColumns(
        {
            **{c: _number_or(c, middle[c]) if c in middle else F.col(q(c)).cast("double") for c in numeric},
            **{c: F.coalesce(F.col(q(c)), F.lit(common[c])) for c in texts if c in common},
        }
    )


def fill_constant(df: DataFrame, mapping: dict[str, object]) -> DataFrame:
    return df.na.fill(mapping)


def fill_forward(
    df: DataFrame, col: str, order: list, by: list[str], out: str | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """Last known value in ``order`` inside each ``by`` group."""
    name = out or f"{col}_ffill"
    return OrderedRows(df, by, order, rows_per_bucket).previous(col, name).result()


def fill_backward(
    df: DataFrame, col: str, order: list, by: list[str], out: str | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """Next known value in ``order`` inside each ``by`` group."""
    name = out or f"{col}_bfill"
    return OrderedRows(df, by, order, rows_per_bucket).following(col, name).result()


def interpolate(
    df: DataFrame, col: str, order: list, by: list[str], out: str | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """Straight line between known values by row position.

    Leading gaps stay, trailing gaps take the last value. The distance in rows to the known
    neighbours is the difference of running row counts, so no position column is needed
    before the neighbours are known.
    """
    name = out or f"{col}_linear"
    point = F.when(F.col(q(col)).isNotNull(), F.struct(F.col("__pos").alias("pos"), F.col(q(col)).cast("double").alias("v")))
    ordered = OrderedRows(df, by, order, rows_per_bucket).row_number("__pos").then("__pos", "__point", point)
    known = ordered.previous("__point", "__before").following("__point", "__after").result()
    before, after = F.col("__before"), F.col("__after")
    gap = after["pos"] - before["pos"]
    line = before["v"] + (after["v"] - before["v"]) * F.try_divide(F.col("__pos") - before["pos"], gap)
    value = F.when(F.col(q(col)).isNotNull(), F.col(q(col)).cast("double")).when(
        before.isNotNull() & after.isNotNull(), line
    ).otherwise(before["v"])
    return known.withColumn(name, value).drop("__pos", "__point", "__before", "__after")


def knn_impute(
    df: DataFrame, key: str, col: str, features: list[str], k: int = 5, out: str | None = None,
    leaf_rows: int | None = None,
) -> DataFrame:
    """Mean of the ``k`` nearest rows that hold ``col``; see :mod:`neighbours`."""
    return neighbours.knn_impute(df, key, col, features, k, out or f"{col}_knn", leaf_rows)


def advanced_imputation(
    df: DataFrame, col: str, method: str = "knn", *, key: str | None = None, order: list | None = None,
    by: list[str] | None = None, features: list[str] | None = None, k: int = 5,
) -> DataFrame:
    """One entry point for the four methods; an absent column or unknown method changes nothing."""
    if col not in df.columns or df.where(F.col(q(col)).isNull()).isEmpty():
        return df
    numbers, _ = split_types(df)
    if method == "knn":
        others = [c for c in (features or numbers) if c not in (col, key)]
        if not others:
            return df  # nothing to measure a distance by
        filled = knn_impute(df, key, col, others, k, out="__filled")
    elif method in ("forward_fill", "backward_fill", "interpolation"):
        if not order:
            raise ValueError(f"{method} needs an order")
        fill = {"forward_fill": fill_forward, "backward_fill": fill_backward, "interpolation": interpolate}[method]
        if method == "interpolation" and col not in numbers:
            return df
        filled = fill(df, col, order, by or [], out="__filled")
    else:
        return df
    return filled.withColumn(col, F.col("__filled")).drop("__filled").select(*[F.col(q(c)) for c in df.columns])
