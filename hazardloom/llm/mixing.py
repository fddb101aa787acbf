"""Mixing sources to target weights by pivotal dependent rounding.

Targets share a budget of words by weight and stop at ``cap`` times the source's words; the excess
goes to the other sources by weight. A source's rate (target / words) gives each of its documents
the same expected copies; the whole part is taken, the fraction is rounded by the pivotal method: two
fractions meet, mass moves at random from one to the other until one is 0 or 1, the other goes on.
Sources are cut into blocks, a block leaves at most one fraction, and the residuals of
``FAN`` blocks meet on the next level of a reduction tree until one per source is left. Neighbours in
size meet first, so the sum of taken words stays close to the target.

All draws come from hashes of the row, so reruns and other partitionings agree.

Edge cases: null texts have size 0; null sources form one source, ranked last; sources without
words have target 0; identical rows get numbers, which spread them over blocks like other rows; ties in
size meet in the order of their draws; long texts only count their words; an empty table gives an empty
result; extra columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import broadcast_if_small, stored, text_key, words

WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_ROWS, FAN, EPS = 2_000, 64, 1e-9


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Water filling: sources in the order of cap / weight are full as long as an equal level above
    them would exceed their cap. The windows run over the table of sources, one row each.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    rows = sizes.withColumn("weight", pick).withColumn("most", F.col("source_size") * cap)
    rows = rows.withColumn("level", F.col("most") / F.col("weight"))
    rising = Window.orderBy("level", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    budget = share * F.sum("source_size").over(everyone)
    left = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("fair", left / weight_left)
    rows = rows.withColumn("full", F.col("fair") >= F.col("level"))
    # the first source that is not full fixes the level of all later ones
    level = F.min(F.when(~F.col("full"), F.struct("level", "fair"))).over(everyone)["fair"]
    return rows.select(
        "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target")
    )


def _pivot(rows: list[tuple[float, float]], last: bool) -> tuple[list[int | None], float]:
    """Round fractions: (p, draw) in order; None marks the one that is left, with its mass."""
    out: list[int | None] = [0] * len(rows)
    held, mass = -1, 0.0
    for i, (p, u) in enumerate(rows):
        if p <= EPS or p >= 1 - EPS:
            out[i] = int(round(p))
            continue
        if held < 0:
            held, mass = i, p
            continue
        both = mass + p
        if both < 1:
            stays, loser, rest = (held, i, both) if u * both >= p else (i, held, both)
            out[loser] = 0
        else:
            # one of the two becomes 1, the other keeps what is left over
            wins = u * (2 - both) < 1 - p
            stays, winner, rest = (i, held, both - 1) if wins else (held, i, both - 1)
            out[winner] = 1
        held, mass = stays, rest
        if mass <= EPS or mass >= 1 - EPS:
            out[held], held = int(round(mass)), -1
    if held >= 0:
        if last:
            out[held], mass = int(rows[held][1] < mass), 0.0
        else:
            out[held] = None
    return out, mass if held >= 0 else 0.0


def _round_group(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    # large documents first: what is left at the end, and is rounded last, is a small one
    pdf = pdf.sort_values(["size", "draw", "tie"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    found, mass = _pivot(list(zip(pdf["p"], pdf["draw"])), last)
    pdf["extra"] = pd.array([None if x is None else x for x in found], dtype="Int64")
    pdf["p"] = [mass if x is None else 0.0 for x in found]
    return pdf


def _next_round(pdf: pd.DataFrame) -> pd.DataFrame:
    return _round_group(pdf, False)


def _last_round(pdf: pd.DataFrame) -> pd.DataFrame:
    return _round_group(pdf, True)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def plan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
    share: float = SHARE, cap: float = CAP, block_rows: int = BLOCK_ROWS, seed: int = 7,
) -> DataFrame:
    """Per row: key, source, size, source_size, target, ``copies`` and ``taken`` words, text key ``tie``."""
    t = F.col(f"`{text}`")
    rows = stored(
        docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), size_of(t).alias("size"), text_key(t).alias("tie")),
        "mix-sizes",
    )
    known = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "mix-sources")
    most = known.agg(F.max("rows")).first()[0] or 0
    goal = targets(known.select("source", "source_size"), weights, share, cap)
    goal = goal.join(known.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = broadcast_if_small(stored(goal, "mix-targets").withColumnRenamed("source", "s"), 200)
    # equal rows are counted, then numbered, so that neither blocks nor draws depend on their places
    equal = rows.groupBy("id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n"))
    # in two steps: no array holds all numbers of a hot row
    rows = equal.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(4096).cast("long"))))
    numbers = F.sequence("from", F.least(F.col("n"), F.col("from") + 4095))
    rows = rows.select("id", "source", "size", "tie", F.explode(numbers).alias("number"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + EPS)
    hashed = F.pmod(F.xxhash64("id", "tie", "number", F.lit(seed)), F.ceil(F.col("rows") / block_rows))
    rows = (
        rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rate", rate)
        .withColumn("whole", whole.cast("long"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
        .withColumn("block", hashed.cast("long"))
        .withColumn("draw", _uniform(F.col("id"), F.col("tie"), F.col("number"), F.lit(seed + 1)))
        .drop("s", "rows", "rate", "number")
    )
    # every level leaves one fraction per group; 'extra' is null where it is still open
    schema = f"{_ddl(rows)}, extra long"
    level0 = stored(
        rows.groupBy("source", "block").applyInPandas(_next_round, schema), "mix-level"
    )
    open_rows = level0.where("extra is null").select("source", "block", "p", "size", "draw", "tie", F.col("block").alias("group"))
    levels = max(1, math.ceil(math.log(max(math.ceil(most / block_rows), 2), FAN)))
    settled = None
    for level in range(levels):
        last = level == levels - 1
        up = open_rows.withColumn("group", F.expr(f"group div {FAN}")).withColumn(
            "draw", _uniform(F.col("draw"), F.col("block"), F.lit(seed + 2 + level))
        )
        up = up.drop("extra")
        done = stored(
            up.groupBy("source", "group").applyInPandas(_last_round if last else _next_round, f"{_ddl(up)}, extra long"),
            "mix-level",
        )
        part = done.where("extra is not null").select("source", "block", "extra")
        settled = part if settled is None else settled.union(part)
        open_rows = done.where("extra is null").drop("extra")
    settled = settled.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("extra").alias("late"))
    settled = broadcast_if_small(stored(settled, "mix-residuals"), 200)
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & F.col("extra").isNull()
    copies = F.col("whole") + F.coalesce("extra", "late", F.lit(0).cast("long"))
    return level0.join(settled, on, "left").select(
        F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "tie",
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """``docs`` with every row as often as the plan takes it, columns unchanged.

    Rows equal in key, source and text stand in one of them for the copies of all.
    """
    planned = plan(docs, key, text, source, **settings)
    planned = stored(
        planned.groupBy(F.col(f"`{key}`").alias("i"), F.col(f"`{source}`").alias("s"), "tie").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")
        ),
        "mix-plan",
    )
    single, many = planned.where("rows = 1"), planned.where("rows > 1")
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(packed, F.col(f"`{key}`").alias("__i"), F.col(f"`{source}`").alias("__s"), text_key(F.col(f"`{text}`")).alias("__k"))

    def matched(df: DataFrame, side: DataFrame) -> DataFrame:
        on = F.col("__i").eqNullSafe(F.col("i")) & F.col("__s").eqNullSafe(F.col("s")) & (F.col("__k") == F.col("tie"))
        return df.join(broadcast_if_small(side.select("i", "s", "tie", "copies"), 120), on)

    # repeated rows: one of them stands for all
    some = matched(rows, many).dropDuplicates(["__i", "__s", "__k"]).select("__row", "copies")
    rest = matched(rows, single).select("__row", "copies")
    out = rest.union(some).where("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")
