"""Hilbert-curve sharding: rows near each other in several metadata dimensions share a shard.

Each dimension is quantised into 2**BITS steps at its own quantiles (strings by their whole values, dates and
times as numbers), the steps give the index on the Hilbert curve, rows are sorted by
that index (ties by key hash), and the run is cut into shards whose row counts differ by at most one.
Files written in this order carry narrow minima and maxima in every dimension, so a filter on any of
them skips most files.

Ranks come without one big window: the rows of a curve cell are dealt by key hash into slices of about
``slice_rows``, a window numbers the rows of a slice, and cell and slice offsets come from count tables
(at most 2**(BITS * dimensions) cells). A cell that owns all rows has as many slices as it needs.

Edge cases: null values sort first in every dimension; long strings count whole; equal values share a step; null texts count 0 bytes plus 8 and have the
checksum of the empty text; rows equal in every column are interchangeable; an empty table gives an
empty result; extra columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..operators.ordered import distinct_running
from .shared import broadcast_if_small, stored

BITS, SHARDS, SLICE_ROWS = 4, 24, 2_000


def _number(df: DataFrame, name: str) -> Column:
    """An order-keeping number for a column that is no string; null is the smallest."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int")
    return F.coalesce(c.cast("double"), F.lit(-1e300))


def _text_cuts(df: DataFrame, name: str, steps: int) -> list[str]:
    """Values at which a string column is cut, from the counts of its distinct values: steps - 1 at most."""
    counts = df.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    running = distinct_running(counts, [], "v", "n")
    total = running.agg(F.max("upto")).scalar()
    # the step in which a value's first row lies
    step = F.floor((F.col("upto") - F.col("n")) * steps / total)
    first = running.where("v is not null").groupBy(step.alias("step")).agg(F.min("v").alias("v")).where("step > 0")
    return [r["v"] for r in first.orderBy("v").collect()]


def hilbert_index(steps: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a point with ``bits`` bits per dimension (Skilling's
    transpose form, unrolled into column arithmetic)."""
    n = len(steps)
    x = F.array(*[s.cast("int") for s in steps])

    def layer(x: Column, build) -> Column:
        """The next state of the point, evaluated once."""
        return F.element_at(F.transform(F.array(x), build), 1)

    def undo(q: int, i: int):
        low = q - 1

        def build(v: Column) -> Column:
            a, b = F.get(v, F.lit(0)), F.get(v, F.lit(i))
            swap = a.bitwiseXOR(b).bitwiseAND(F.lit(low))
            on = b.bitwiseAND(F.lit(q)) != 0
            head = F.when(on, a.bitwiseXOR(F.lit(low))).otherwise(a.bitwiseXOR(swap))
            here = F.when(on, b).otherwise(b.bitwiseXOR(swap))
            parts = [F.get(v, F.lit(j)) for j in range(n)]
            parts[0] = head
            if i:
                parts[i] = here
            return F.array(*parts)

        return build

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            x = layer(x, undo(1 << level, i))

    def gray(v: Column) -> Column:
        parts = [F.get(v, F.lit(0))]
        for i in range(1, n):
            parts.append(F.get(v, F.lit(i)).bitwiseXOR(parts[-1]))
        flip = F.lit(0)
        for level in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(parts[-1].bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(0))
        return F.array(*[p.bitwiseXOR(flip) for p in parts])

    x = layer(x, gray)

    def weave(v: Column) -> Column:
        out = F.lit(0).cast("long")
        for level in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(F.get(v, F.lit(i)), level).bitwiseAND(F.lit(1)).cast("long")
                out = out * 2 + bit
        return out

    return layer(x, weave)


def _codes(df: DataFrame, dims: list[str], steps: int, accuracy: int = 10_000) -> list[Column]:
    """The step of every dimension; numbers are cut in one pass over all rows, strings in one each."""
    texts = {d: _text_cuts(df, d, steps) for d in dims if isinstance(df.schema[d].dataType, T.StringType)}
    numbers = {d: _number(df, d) for d in dims if d not in texts}
    shares = [i / steps for i in range(1, steps)]
    found = [F.percentile_approx(c, shares, accuracy).alias(f"q{i}") for i, c in enumerate(numbers.values())]
    row = df.agg(F.lit(1), *found).first()
    cuts = texts | {d: sorted(set(row[f"q{i}"] or [])) for i, d in enumerate(numbers)}

    def code(d: str) -> Column:
        x = numbers.get(d, F.col(f"`{d}`"))
        # a null string lies below all cuts
        return F.size(F.filter(F.array(*[F.lit(q) for q in cuts[d]]), lambda q: q <= x)) if cuts[d] else F.lit(0)

    return [code(d) for d in dims]


def order(df: DataFrame, key: list[str], dims: list[str], bits: int = BITS, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, int]:
    """``df`` plus ``__cell`` (curve index) and ``__rank`` (0, 1, ... in curve order); the row count."""
    cells = df.withColumn("__cell", hilbert_index(_codes(df, dims, 1 << bits), bits))
    bounds = stored(cells.groupBy(F.col("__cell").alias("__c")).agg(F.count(F.lit(1)).alias("__m")), "curve-cells")
    total = bounds.agg(F.coalesce(F.sum("__m"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.ceil(F.col("__m") / slice_rows))
    sliced = cells.join(broadcast_if_small(bounds, 16), F.col("__cell") == F.col("__c")).withColumn("__part", part.cast("long"))
    sliced = sliced.drop("__c", "__m")
    counts = stored(sliced.groupBy("__cell", "__part").agg(F.count(F.lit(1)).alias("__n")), "curve-slices")
    upto = Window.unboundedPreceding
    by_cell = bounds.select(
        F.col("__c").alias("__oc"),
        (F.sum("__m").over(Window.orderBy("__c").rowsBetween(upto, 0)) - F.col("__m")).alias("__base"),
    )
    in_cell = Window.partitionBy("__cell").orderBy("__part").rowsBetween(upto, 0)
    offsets = (
        counts.withColumn("__first", F.sum("__n").over(in_cell) - F.col("__n"))
        .join(by_cell, F.col("__cell") == F.col("__oc"))
        .select(F.col("__cell").alias("__oc"), F.col("__part").alias("__op"), (F.col("__base") + F.col("__first")).alias("__off"))
    )
    offsets = broadcast_if_small(stored(offsets, "curve-offsets"), 40)
    keys = [F.col(f"`{k}`").asc_nulls_first() for k in key]
    number = F.row_number().over(Window.partitionBy("__cell", "__part").orderBy(*keys))
    ranked = sliced.withColumn("__row", number).join(
        offsets, (F.col("__cell") == F.col("__oc")) & (F.col("__part") == F.col("__op"))
    )
    rank = (F.col("__off") + F.col("__row") - 1).cast("long")
    return ranked.withColumn("__rank", rank).drop("__oc", "__op", "__off", "__row", "__part"), total


def assign(
    docs: DataFrame, key: str = "doc_id", text: str = "text", dims: list[str] | None = None, shards: int = SHARDS,
    bits: int = BITS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Per row: key, size in bytes, checksum, law, ``shard``, ``slot`` in it and curve index."""
    dims = dims or ["lang", "source", "size"]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{key}`").alias("__id"),
        *[F.col(f"`{d}`").alias(f"__d_{d}") for d in dims if d != "size"],
        (F.octet_length(t) + 8).cast("long").alias("__d_size"),
        F.crc32(F.encode(t, "UTF-8")).alias("__crc"),
    )
    ranked, total = order(narrow, ["__id", "__crc"], [f"__d_{d}" for d in dims], bits, slice_rows)
    rank, n = F.col("__rank"), max(total, 1)
    shard = F.expr(f"(__rank * {shards}) div {n}")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).select(
        F.col("__id").alias(key),
        F.col("__d_size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (rank - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__cell").alias("curve_index"),
    )


def write_shards(docs: DataFrame, path: str, key: str, dims: list[str], shards: int = SHARDS, **settings) -> None:
    """Write ``docs`` as Parquet files that are runs of the curve, in folders ``shard=0..``."""
    ranked, total = order(docs, [key], dims, **settings)
    shard = F.expr(f"cast((__rank * {shards}) div {max(total, 1)} as int)")
    out = ranked.withColumn("shard", shard).repartitionByRange(shards, "__rank").sortWithinPartitions("__rank")
    out.drop("__rank", "__cell").write.partitionBy("shard").parquet(path)
