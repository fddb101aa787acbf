"""Feature preparation for models."""

from __future__ import annotations

from pyspark.ml.feature import (
    HashingTF,
    IDF,
    OneHotEncoder,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx
from ..functions.values import safe_log1p, safe_sqrt
from ..session import cut, stored
from .missing import impute_median_mode
from .ordered import OrderedRows
from .quantiles import value_counts
from .schema import q, split_types
from .sizing import match, measured, small


def categories(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column, all columns in one pass: they become column names."""
    found: dict[str, list[str]] = {c: [] for c in cols}
    for r in value_counts(df, cols).select("column", "value").collect():
        found[r["column"]].append(r["value"])
    return {c: sorted(values) for c, values in found.items()}


def _written(c: str) -> Column:
    """A value as text; a missing one is 'nan'."""
    return F.coalesce(F.col(q(c)).cast("string"), F.lit("nan"))


def dictionary(df: DataFrame, cols: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """``(column, value, code)``: the distinct values of every column, numbered in alphabetical order.

    Values are numbered in leaves of an ordered scan, so a column of any number of values stays a
    table. 'nan' is there for columns with missing values.
    """
    each = F.array(*[F.struct(F.lit(c).alias("column"), _written(c).alias("value")) for c in cols])
    distinct = df.select(F.inline(each)).distinct()
    numbered = OrderedRows(distinct, ["column"], ["value"], rows_per_bucket).row_number("__rn").result()
    return cut(numbered.select("column", "value", (F.col("__rn") - 1).cast("int").alias("code")))


def encode_categorical(df: DataFrame, cols: list[str], columns: bool = True, rows_per_bucket: int | None = None) -> DataFrame:
    """Alphabetical code ``<col>_encoded`` ('nan' for null) and indicators per value, none set for null.

    Indicators are columns ``<col>_<value>``, whose names come to the driver, or for columns of many values
    (``columns=False``) one sparse vector ``<col>_indicators`` with the slot of the value's code.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    known = dictionary(df, cols, rows_per_bucket)
    sizes = {r["column"]: r["n"] for r in known.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for i, c in enumerate(cols):
        own = small(known.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias(f"{c}_encoded")))
        out = out.join(own, _written(c) == F.col("__v"), "left").drop("__v")
        if columns or c not in sizes:
            continue
        slot = F.when(F.col(q(c)).isNull(), sizes[c]).otherwise(F.col(q(f"{c}_encoded"))).cast("double")
        # the index behind the last value stands for a missing one and is dropped: no slot is set
        encoder = OneHotEncoder(inputCol="__slot", outputCol=f"{c}_indicators", dropLast=True, handleInvalid="keep")
        model = encoder.fit(df.sparkSession.createDataFrame([(float(sizes[c] - 1),)], "__slot double"))
        out = model.transform(out.withColumn("__slot", slot)).drop("__slot")
    if not columns:
        return out
    found = categories(df, cols)
    flags = {f"{c}_{v}": F.coalesce(F.col(q(c)).cast("string") == v, F.lit(False)) for c in cols for v in found[c]}
    codes = [F.col(q(f"{c}_encoded")) for c in cols]
    return out.withColumns(flags).select(*[F.col(q(c)) for c in df.columns], *[F.col(q(n)) for n in flags], *codes)


def numeric_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<col>_log``, ``<col>_sqrt`` and ``<col>_scaled`` (population deviation; 0 for a constant)."""
    cols = [c for c in cols if c in df.columns]
    stats = df.agg(
        *[F.avg(F.col(q(c))).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(q(c))).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    added: dict[str, Column] = {}
    for i, c in enumerate(cols):
        added[f"{c}_log"] = safe_log1p(F.col(q(c)))
        added[f"{c}_sqrt"] = safe_sqrt(F.col(q(c)))
        mean, spread = stats[f"m{i}"], stats[f"s{i}"]
        added[f"{c}_scaled"] = (F.col(q(c)).cast("double") - F.lit(mean)) / F.lit(spread if spread else 1.0)
    return df.withColumns(added)


def anova_f(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """``(feature, f_value)`` of the one-way analysis of variance, one grouped pass for all columns.

    Group means and deviations come from numerically stable aggregates; rows with a null in a
    column do not count for that column.
    """
    rows = df.where(F.col(q(target)).isNotNull())
    per_class = rows.groupBy(F.col(q(target)).alias("__class")).agg(
        *[
            F.struct(
                F.count(F.col(q(c))).alias("n"),
                F.avg(F.col(q(c))).alias("mean"),
                F.var_pop(F.col(q(c)).cast("double")).alias("var"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ]
    )
    long = per_class.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("s")) for i, c in enumerate(cols)]))
    ).select("feature", "s.*").where("n > 0")
    grand = long.groupBy("feature").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
    )
    between = F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand")))
    within = F.sum(F.col("n") * F.col("var"))
    return (
        long.join(grand, "feature")
        .groupBy("feature", "total", "k")
        .agg(between.alias("between"), within.alias("within"))
        .select(
            "feature",
            F.try_divide(
                F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("total") - F.col("k"))
            ).alias("f_value"),
        )
    )


def select_k_best(df: DataFrame, target: str, cols: list[str] | None = None, k: int = 10) -> list[str]:
    """The ``k`` numeric features with the largest F, in column order."""
    names = cols if cols is not None else [c for c in split_types(df)[0] if c != target]
    ranked = anova_f(df, target, names).orderBy(F.desc_nulls_last("f_value"), "feature").limit(k).collect()
    chosen = {r["feature"] for r in ranked}
    return [c for c in names if c in chosen]


def preprocess(
    df: DataFrame, numeric: list[str], categorical: list[str], out: str = "features"
) -> tuple[DataFrame, list[str]]:
    """Median + min-max for numbers, mode + one-hot for categories, as one vector with names.

    Names are ``num__<col>`` and ``cat__<col>_<value>``. A constant column scales to 0.
    """
    filled = impute_median_mode(df, numeric, categorical)
    ranges = filled.agg(
        *[F.min(F.col(q(c))).cast("double").alias(f"a{i}") for i, c in enumerate(numeric)],
        *[F.max(F.col(q(c))).cast("double").alias(f"b{i}") for i, c in enumerate(numeric)],
        F.lit(1),
    ).first()
    scaled = {}
    for i, c in enumerate(numeric):
        low, high = ranges[f"a{i}"], ranges[f"b{i}"]
        width = (high - low) if low is not None and high > low else 1.0
        scaled[f"__num_{i}"] = (F.col(q(c)).cast("double") - F.lit(low or 0.0)) / F.lit(width)
    prepared = filled.withColumns(scaled) if scaled else filled
    names = [f"num__{c}" for c in numeric]
    blocks = list(scaled)
    if categorical:
        indexer = StringIndexer(
            inputCols=categorical, outputCols=[f"__idx_{i}" for i in range(len(categorical))],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ).fit(prepared)
        prepared = indexer.transform(prepared)
        encoder = OneHotEncoder(
            inputCols=indexer.getOutputCols(), outputCols=[f"__hot_{i}" for i in range(len(categorical))],
            dropLast=True,
        )
        # the extra index of unknown values is the dropped one, so they encode as all zeros
        prepared = encoder.fit(prepared).transform(prepared)
        blocks += [f"__hot_{i}" for i in range(len(categorical))]
        for c, labels in zip(categorical, indexer.labelsArray):
            names += [f"cat__{c}_{v}" for v in labels]
    vector = VectorAssembler(inputCols=blocks, outputCol=out, handleInvalid="error").transform(prepared)
    return vector.drop(*[c for c in vector.columns if c.startswith(("__num_", "__idx_", "__hot_"))]), names


def encode_label(df: DataFrame, col: str, out: str = "label") -> tuple[DataFrame, DataFrame]:
    """Alphabetical class codes, plus the mapping ``(code, class)``."""
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    mapping = df.sparkSession.createDataFrame(
        list(enumerate(model.labelsArray[0])), "code int, class string"
    )
    return model.transform(df), mapping


def assemble(df: DataFrame, blocks: list[str], out: str = "features") -> DataFrame:
    """Feature blocks (numbers or vectors) side by side in the given order."""
    return VectorAssembler(inputCols=blocks, outputCol=out).transform(df)


def _mark(key: list[str], seed: int) -> Column:
    text = F.concat_ws("|", *[F.col(q(k)).cast("string") for k in key], F.lit(str(seed)))
    return F.md5(text)


#: The first characters of a mark, by which rows are counted before any are put in order.
_MARK_HEAD = 3


def _share(
    df: DataFrame, by: list[str], key: list[str], seed: int, take, out: str, rows_per_bucket: int | None
) -> DataFrame:
    """Add ``out``: whether a row is among the first ``take(n)`` of the ``n`` rows of its group, by hashed key.

    Rows are counted by group and the first characters of their mark. These settle all rows but those of
    the one head in which a group's share ends: only they are put in order.
    """
    by = [F.lit(True).alias("__g0")] if not by else [F.col(q(c)).alias(f"__g{i}") for i, c in enumerate(by)]
    groups = [f"__g{i}" for i in range(len(by))]
    rows = stored(df.select("*", *by, F.left(_mark(key, seed), F.lit(_MARK_HEAD)).alias("__head")), "split")
    counts = rows.groupBy(*groups, "__head").agg(F.count(F.lit(1)).alias("__n"))
    # at most 16 ** _MARK_HEAD heads a group
    upto = Window.partitionBy(*groups).orderBy("__head").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__n").over(Window.partitionBy(*groups))
    heads = counts.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__take", F.least(take(total), total))
    before = F.col("__upto") - F.col("__n")
    ends = heads.where((before < F.col("__take")) & (F.col("__take") <= F.col("__upto")))
    ends = measured(ends.select(*groups, F.col("__head").alias("__end"), (F.col("__take") - before).alias("__left")))
    placed = match(rows, ends, groups, "left")
    columns = [F.col(q(c)) for c in df.columns]
    settled = placed.where(~F.col("__head").eqNullSafe(F.col("__end")))
    settled = settled.select(*columns, F.coalesce(F.col("__head") < F.col("__end"), F.lit(False)).alias(out))
    undecided = placed.where(F.col("__head") == F.col("__end")).withColumn("__mark", _mark(key, seed))
    scan = OrderedRows(undecided, groups, ["__mark", *[F.col(q(k)) for k in key]], rows_per_bucket)
    ordered = scan.row_number("__rn").result().select(*columns, (F.col("__rn") <= F.col("__left")).alias(out))
    return settled.unionByName(ordered)


def stratified_split(
    df: DataFrame, label: str, key: list[str], ratio: float = 0.25, seed: int = 42, rows_per_bucket: int | None = None
) -> DataFrame:
    """Add ``is_test``: exactly ``round(ratio * n)`` rows of every class, chosen by hashed key."""
    return _share(df, [label], key, seed, lambda n: F.round(n * ratio), "is_test", rows_per_bucket)


def split(
    df: DataFrame, key: list[str], ratio: float = 0.2, seed: int = 42, rows_per_bucket: int | None = None
) -> DataFrame:
    """Add ``is_validation``: ``round(ratio * n)`` rows, at least one if ``ratio`` is positive."""
    if not 0.0 <= ratio < 1.0:
        raise ValueError("ratio must be in [0, 1)")
    if ratio == 0:
        return df.withColumn("is_validation", F.lit(False))
    return _share(df, [], key, seed, lambda n: F.greatest(F.lit(1.0), F.bround(n * ratio)), "is_validation", rows_per_bucket)


def embed_text(
    df: DataFrame, key: str, col: str, encoder=None, size: int = 256, limit: int | None = 4096, batch: int = 16
) -> DataFrame:
    """``(row_id, embedding array<float>)``: one vector per row.

    Without an encoder: hashed term weights. With one: ``encoder()`` is called once per task and
    returns a function from a list of texts to a list of vectors; it receives ``batch`` texts at
    a time. ``limit`` is the encoder's input length in tokens, ``None`` for no limit; hashed
    vectors always take the whole text.
    """
    words = tx.tokens(F.coalesce(F.col(q(col)).cast("string"), F.lit("")))
    kept = words if limit is None or encoder is None else F.slice(words, 1, limit)
    source = df.select(F.col(q(key)).alias("row_id"), kept.alias("words"))
    if encoder is None:
        counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=size).transform(source)
        weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
        return weighted.select("row_id", vector_to_array("tfidf", "float32").alias("embedding"))
    schema = T.StructType([source.schema["row_id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames):
        encode = encoder()
        for frame in frames:
            texts = [" ".join(w) for w in frame["words"]]
            vectors = []
            for i in range(0, len(texts), batch):
                vectors.extend(encode(texts[i : i + batch]))
            yield frame[["row_id"]].assign(embedding=[[float(x) for x in v] for v in vectors])

    return source.mapInPandas(run, schema)
