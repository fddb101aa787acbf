"""Text columns: cleaning, merging, tagging, profiling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.values import plain_text
from ..session import cut
from .ordered import distinct_running
from .schema import q


def clean_columns(
    df: DataFrame,
    cols: list[str],
    suffix: str = "_clean",
    cleaner: Callable[..., Column] = tx.clean_text,
    options: dict | None = None,
) -> DataFrame:
    """Add ``<col><suffix>`` for every listed column that exists; originals stay."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {c + suffix: cleaner(plain_text(F.col(q(c)), types[c]), **(options or {})) for c in cols if c in types}
    )


def merge_text(
    df: DataFrame, cols: list[str], out: str = "text_merged", sep: str = " [SEP] ", strip_values: bool = True
) -> DataFrame:
    """Listed columns joined in order, nulls and blanks skipped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [plain_text(F.col(q(c)), types[c]) for c in cols if c in types]
    if strip_values:
        parts = [tx.strip(p) for p in parts]
    return df.withColumn(out, F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep))


def tag_keywords(df: DataFrame, col: str, words: list[str], out: str = "keywords") -> DataFrame:
    return df.withColumn(out, tx.found_words(F.col(q(col)), words))


def keyword_counts(df: DataFrame, col: str, words: list[str]) -> DataFrame:
    return (
        df.select(F.explode(tx.found_words(F.col(q(col)), words)).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sentiment(
    df: DataFrame, col: str, positive: list[str] = tx.POSITIVE_WORDS, negative: list[str] = tx.NEGATIVE_WORDS
) -> DataFrame:
    return df.withColumns(
        {
            "positive_score": tx.word_hits(F.col(q(col)), positive),
            "negative_score": tx.word_hits(F.col(q(col)), negative),
        }
    ).withColumn("sentiment", tx.sentiment_label(F.col("positive_score"), F.col("negative_score")))


def sentiment_counts(df: DataFrame, col: str) -> DataFrame:
    return sentiment(df, col).groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


def full_text(
    df: DataFrame, cols: list[str], out: str = "full_text", narrative: str = "narrative", narrative_last: bool = True
) -> DataFrame:
    """``"col value, col value,"`` over the listed columns; nulls read 'NA'."""
    types = {f.name: f.dataType for f in df.schema.fields}
    ordered = [c for c in cols if c in types]
    if narrative_last and narrative in ordered:
        ordered = [c for c in ordered if c.lower() != narrative] + [narrative]
    parts = [
        F.concat(F.lit(c + " "), F.coalesce(plain_text(F.col(q(c)), types[c]), F.lit("NA")), F.lit(",")) for c in ordered
    ]
    return df.withColumn(out, F.concat_ws(" ", *parts))


def preview(df: DataFrame, cols: list[str], order: list[str], n: int = 3, narrative: str = "narrative") -> DataFrame:
    """First ``n`` rows by ``order``, numbered from 1, the narrative shortened for display."""
    head = df.orderBy(*order).limit(n)
    numbered = head.select(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))).alias("rows"))
    # at most n rows reach the array
    rows = numbered.select(F.posexplode("rows").alias("position", "r")).select("position", "r.row.*")
    shown = [tx.shorten(c).alias(c) if c == narrative else F.col(q(c)) for c in cols]
    return rows.select((F.col("position") + 1).alias("position"), *shown)


def text_quality(df: DataFrame, col: str) -> DataFrame:
    """Missing rate, counts and length statistics of non-blank text in one pass."""
    s = F.col(q(col)).cast("string")
    blank = tx.is_blank(s)
    length = F.when(~blank, F.length(s))
    stats = df.agg(
        F.avg(blank.cast("double")).alias("missing_rate"),
        F.count(length).alias("non_empty_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.avg(length).alias("mean_length"),
        F.stddev_samp(length).alias("std_length"),
    )
    some = F.col("non_empty_count") > 0
    return stats.withColumns(
        {c: F.when(some, F.col(c)).otherwise(F.lit(0)) for c in ("min_length", "max_length", "mean_length", "std_length")}
    )


def top_tokens(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Most frequent tokens of the non-blank texts, ties by token."""
    s = F.col(q(col)).cast("string")
    return (
        df.where(~tx.is_blank(s))
        .select(F.explode(tx.tokens(s)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(n)
    )


def histogram(
    df: DataFrame, value: Column, bins: int, low: Column | None = None, high: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """``(bin, bin_from, bin_to, n)`` with equal-width bins, the last one closed; empty bins count 0.

    ``weight`` is the number of rows a row stands for. The range is a one-row subquery, so no row
    is paired with another.
    """
    x = df.select(value.cast("double").alias("x"), (weight if weight is not None else F.lit(1)).alias("w"))
    x = x.where("x is not null")
    lo = low if low is not None else x.agg(F.min("x")).scalar()
    hi = high if high is not None else x.agg(F.max("x")).scalar()
    flat = lo == hi
    # a single value sits in the middle of a range of width one
    start, stop = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    binned = x.select("x", "w", start.alias("a"), stop.alias("b")).where("x between a and b")
    place = F.least(F.floor((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)) + 1
    counts = binned.groupBy(place.alias("bin")).agg(F.sum("w").alias("n"))
    width = (stop - start) / bins
    every = df.sparkSession.range(1, bins + 1).select(
        F.col("id").alias("bin"),
        (start + (F.col("id") - 1) * width).alias("bin_from"),
        (start + F.col("id") * width).alias("bin_to"),
    )
    return every.join(counts, "bin", "left").select("bin", "bin_from", "bin_to", F.coalesce("n", F.lit(0)).alias("n"))


def length_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Histogram of non-blank text lengths; the texts are measured once."""
    s = F.col(q(col)).cast("string")
    lengths = df.where(~tx.is_blank(s)).groupBy(F.length(s).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return histogram(cut(lengths), F.col("length"), bins, weight=F.col("n"))


def token_lengths(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.size(tx.tokens(F.coalesce(F.col(q(col)).cast("string"), F.lit("")))).alias("n_tokens"))


def token_length_counts(df: DataFrame, col: str) -> DataFrame:
    """``(n_tokens, n)``: rows per token count. Everything about lengths follows from this small
    table, so the texts are read and split once.
    """
    return cut(token_lengths(df, col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")))


def token_length_report(df: DataFrame, col: str, limits: tuple[int, ...] = (512, 4096)) -> DataFrame:
    """Row count, max, min, mean and median token count, and how many rows exceed each limit."""
    counts = token_length_counts(df, col)
    stats = counts.agg(
        F.sum("n").alias("total_rows"),
        F.max("n_tokens").alias("max_tokens"),
        F.min("n_tokens").alias("min_tokens"),
        (F.sum(F.col("n_tokens") * F.col("n")) / F.sum("n")).alias("mean_tokens"),
        *[F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n"))), F.lit(0)).alias(f"over_{x}") for x in limits],
    )
    running = distinct_running(counts, [], "n_tokens", "n")
    half = (counts.agg(F.sum("n")).scalar() - 1) / 2.0
    before = F.col("upto") - F.col("n")

    def holds(rank: Column) -> Column:
        return (before <= rank) & (rank < F.col("upto"))

    placed = running.withColumn("half", half)
    low = F.max(F.when(holds(F.floor("half")), F.col("n_tokens")))
    high = F.max(F.when(holds(F.ceil("half")), F.col("n_tokens")))
    middle = placed.agg(((low + high) / 2.0).alias("m")).scalar()
    return stats.withColumns(
        {
            "median_tokens": middle,
            **{f"over_{n}_percent": F.try_divide(100.0 * F.col(f"over_{n}"), F.col("total_rows")) for n in limits},
        }
    )


def token_length_histogram(df: DataFrame, col: str, bins: int = 100, limit: int = 4096) -> DataFrame:
    """Token counts over a range that always includes the model limit."""
    counts = token_length_counts(df, col)
    top = counts.agg((F.greatest(F.max("n_tokens"), F.lit(limit)) + 10).alias("top")).scalar()
    return histogram(counts, F.col("n_tokens"), bins, F.lit(0.0), top.cast("double"), F.col("n"))


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows chosen by a seeded hash of the key: the same rows on every run and layout."""
    mark = F.md5(F.concat(F.col(q(key)).cast("string"), F.lit(f"#{seed}")))
    return df.orderBy(mark, F.col(q(key))).limit(k)
