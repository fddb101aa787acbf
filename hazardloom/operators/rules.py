"""Frequent condition combinations, association rules, risk of combinations."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import scenario_id
from ..functions.values import plain_text
from ..session import cut
from .schema import q
from .sizing import match, small


class Patterns(NamedTuple):
    itemsets: DataFrame
    rules: DataFrame
    summary: DataFrame
    top: DataFrame


def _parts(df: DataFrame, cols: list[str], build) -> list[Column]:
    """One condition per column, null where the value is null or empty."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in cols:
        value = plain_text(F.col(q(c)), types[c])
        parts.append(F.when(value.isNotNull() & (value != ""), build(c, value)))
    return parts


def _items(parts: list[Column], dtype: str = "string") -> Column:
    """Sorted distinct conditions without the nulls."""
    return F.sort_array(F.array_except(F.array(*parts), F.array(F.lit(None).cast(dtype))))


def _named(c: str, value: Column) -> Column:
    return F.concat(F.lit(c + "_"), value)


def transactions(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """``key`` and ``items`` (``col_value``); rows without any item are left out."""
    parts = _parts(df, cols, _named)
    some = df.where(F.coalesce(*parts).isNotNull())
    return some.select(*[F.col(q(k)) for k in key], _items(parts).alias("items"))


def weighted_transactions(df: DataFrame, cols: list[str]) -> DataFrame:
    """``items`` and ``w``: equal rows merged by their raw values before any item is built.

    Empty lists stay until :func:`frequent_itemsets` has stored the merged rows: a filter here
    would be pushed below the merge and build the items of every single row.
    """
    counted = df.groupBy(*[F.col(q(c)) for c in cols]).agg(F.count(F.lit(1)).alias("w"))
    return counted.select(_items(_parts(counted, cols, _named)).alias("items"), "w")


def _grow(
    weighted: DataFrame, by: list[str], extra: list[str], totals: DataFrame, min_support: float, max_len: int | None
) -> list[DataFrame]:
    """Frequent itemsets level by level from distinct item lists with a weight.

    ``weighted`` holds ``by``, ``extra``, sorted ``items`` and ``w``: equal rows were merged before,
    so the work follows the number of distinct rows. Infrequent items leave the rows after the
    first level; a prefix is extended only by later items of the same row and only while it is
    frequent itself. One materialized table per level: ``by, items, extra, n, n_items, n_all``.
    """
    after = F.expr("slice(items, p + 2, size(items))")
    weighted = cut(weighted.withColumn("__row", F.monotonically_increasing_id()))
    single = weighted.select(*by, *extra, "__row", "w", F.explode("items").alias("item"))
    grown = single.withColumn("itemset", F.array("item"))
    levels: list[DataFrame] = []
    while max_len is None or len(levels) < max_len:
        counts = grown.groupBy(*by, "itemset", *extra).agg(F.sum("w").alias("n"))
        sums = counts.groupBy(*by, "itemset").agg(F.sum("n").alias("n_items")) if extra else counts.withColumnRenamed("n", "n_items")
        sized = match(sums, totals, by) if by else sums.withColumn("n_all", totals.select("n_all").scalar())
        frequent = sized.where(F.col("n_items") / F.col("n_all") >= min_support)
        level = cut(match(counts, frequent, [*by, "itemset"]) if extra else frequent.withColumn("n", F.col("n_items")))
        if level.isEmpty():
            break
        levels.append(level)
        if max_len is not None and len(levels) == max_len:
            break
        known = small(level.select(*by, "itemset").distinct())
        if len(levels) == 1:
            # an infrequent item cannot extend anything: rows go on with their frequent items only
            items = match(grown.select(*by, *extra, "__row", "w", "item", "itemset"), known, [*by, "itemset"], "left_semi")
            lists = items.groupBy(*by, *extra, "__row", "w").agg(F.sort_array(F.collect_list("item")).alias("items"))
            started = lists.select(*by, *extra, "w", F.posexplode("items").alias("p", "item"), "items")
            alive = started.select(*by, *extra, "w", F.array("item").alias("itemset"), after.alias("rest"))
        else:
            alive = match(grown, known, [*by, "itemset"], "left_semi")
        longer = alive.where(F.size("rest") > 0).select(
            *by, *extra, "w", "itemset", F.posexplode("rest").alias("p", "item"), F.col("rest").alias("items")
        )
        grown = cut(longer.select(*by, *extra, "w", F.concat("itemset", F.array("item")).alias("itemset"), after.alias("rest")))
    return levels


def frequent_itemsets(tx: DataFrame, min_support: float = 0.1, max_len: int | None = None) -> DataFrame:
    """``(items, support, n)`` of all item sets in at least ``min_support`` of the transactions.

    ``tx`` has ``items`` and, if equal transactions were merged, their number ``w``.
    """
    weight = F.sum("w") if "w" in tx.columns else F.count(F.lit(1))
    merged = cut(tx.groupBy(F.array_sort(F.array_distinct("items")).alias("items")).agg(weight.alias("w")))
    weighted = merged.where(F.size("items") > 0)
    totals = weighted.agg(F.sum("w").alias("n_all"))
    levels = _grow(weighted, [], [], totals, min_support, max_len)
    found = [
        level.select(F.col("itemset").alias("items"), (F.col("n") / F.col("n_all")).alias("support"), "n")
        for level in levels
    ]
    if not found:
        return tx.sparkSession.createDataFrame([], "items array<string>, support double, n long")
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


def association_rules(
    itemsets: DataFrame, min_confidence: float = 0.5, min_lift: float | None = None
) -> DataFrame:
    """Splits of every item set into antecedent and consequent, with the usual measures.

    Confidence only falls when an item moves from the antecedent to the consequent, so consequents
    grow item by item from those that still reach ``min_confidence``; sets of any size are fine.
    """
    supports = itemsets.select("items", F.col("support").alias("s"))
    a = supports.select(F.col("items").alias("antecedent"), F.col("s").alias("antecedent_support"))
    c = supports.select(F.col("items").alias("consequent"), F.col("s").alias("consequent_support"))
    grown = itemsets.where(F.size("items") >= 2).select(
        "items", "support", F.expr("explode(transform(items, (x, i) -> array(i)))").alias("moved")
    )
    levels: list[DataFrame] = []
    while True:
        split = grown.withColumn("antecedent", F.expr("filter(items, (x, i) -> not array_contains(moved, i))"))
        kept = split.join(a, "antecedent").withColumn("confidence", F.col("support") / F.col("antecedent_support"))
        level = cut(kept.where(F.col("confidence") >= min_confidence))
        levels.append(level)
        if level.isEmpty():
            break
        later = F.expr("explode(filter(sequence(0, size(items) - 1), i -> i > element_at(moved, -1)))")
        grown = level.where(F.size("antecedent") > 1).select("items", "support", "moved", later.alias("next"))
        grown = grown.select("items", "support", F.concat("moved", F.array("next")).alias("moved"))
    found = reduce(DataFrame.unionByName, levels)
    rules = found.withColumn("consequent", F.expr("transform(moved, i -> items[i])")).join(c, "consequent")
    sa, sc = F.col("antecedent_support"), F.col("consequent_support")
    rules = rules.select(
        "antecedent",
        "consequent",
        "antecedent_support",
        "consequent_support",
        "support",
        "confidence",
        (F.col("confidence") / sc).alias("lift"),
        (F.col("support") - sa * sc).alias("leverage"),
        F.when(F.col("confidence") < 1, (1 - sc) / (1 - F.col("confidence")))
        .otherwise(F.lit(float("inf")))
        .alias("conviction"),
    )
    return rules if min_lift is None else rules.where(F.col("lift") >= min_lift)


def rule_summary(rules: DataFrame, confidence: float = 0.8, lift: float = 2.0) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("support").alias("avg_support"),
        F.avg("lift").alias("avg_lift"),
        F.count_if(F.col("confidence") > confidence).alias("high_confidence_rules"),
        F.count_if(F.col("lift") > lift).alias("high_lift_rules"),
    )


def top_k(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_rules(rules: DataFrame, n: int = 10, metric: str = "confidence") -> DataFrame:
    return top_k(rules, [F.desc(metric), "antecedent", "consequent"], n)


def mine_patterns(
    df: DataFrame,
    cols: list[str],
    min_support: float = 0.05,
    min_confidence: float = 0.6,
    max_len: int | None = None,
    min_lift: float | None = None,
    top: int = 20,
) -> Patterns:
    """Transactions, item sets, rules, summary and best rules in one call."""
    itemsets = frequent_itemsets(weighted_transactions(df, cols), min_support, max_len)
    rules = cut(association_rules(itemsets, min_confidence, min_lift))
    return Patterns(itemsets, rules, rule_summary(rules), top_rules(rules, top))


def risk_combinations(
    df: DataFrame,
    cols: list[str],
    target: str,
    min_support: float = 0.01,
    max_len: int = 3,
    by: list[str] | None = None,
) -> DataFrame:
    """How much each frequent condition set raises the probability of each class.

    ``by, scenario_id, accident_type, evidence, support_rate, prob, lift, uplift``; one row per
    condition set and class that occur together, shares taken inside each ``by`` group.
    Rows are merged by condition values and class before any combination is formed.
    """
    by = list(by or [])
    parts = _parts(df, cols, lambda c, v: F.struct(F.lit(c).alias("key"), v.alias("value")))
    items = _items(parts, "struct<key:string,value:string>")
    merged = (
        df.where(F.col(q(target)).isNotNull())
        .groupBy(*by, F.col(q(target)).cast("string").alias("accident_type"), *[F.col(q(c)) for c in cols])
        .agg(F.count(F.lit(1)).alias("w"))
    )
    weighted = cut(merged.select(*by, "accident_type", items.alias("items"), "w"))
    totals = weighted.groupBy(*by).agg(F.sum("w").alias("n_all"))
    classes = weighted.groupBy(*by, "accident_type").agg(F.sum("w").alias("n_class"))
    levels = _grow(weighted, by, ["accident_type"], totals, min_support, max_len)
    if not levels:
        raise ValueError("no condition set reaches the support threshold")
    sets = levels[0]
    for frame in levels[1:]:
        sets = sets.unionByName(frame)
    prob = F.col("n") / F.col("n_items")
    base = F.col("n_class") / F.col("n_all")
    return (
        match(sets, classes, [*by, "accident_type"])
        .select(
            *by,
            "accident_type",
            F.map_from_entries("itemset").alias("evidence"),
            (F.col("n_items") / F.col("n_all")).alias("support_rate"),
            prob.alias("prob"),
            (prob / base).alias("lift"),
            (prob - base).alias("uplift"),
        )
        .withColumn("scenario_id", scenario_id("accident_type", "evidence"))
    )


def combination_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("support_rate").alias("avg_support"),
        F.avg("prob").alias("avg_prob"),
        F.avg("uplift").alias("avg_uplift"),
        F.max("uplift").alias("max_uplift"),
        F.max("prob").alias("max_prob"),
    )
