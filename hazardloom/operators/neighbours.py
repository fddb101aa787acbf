"""Exact k-nearest-neighbour imputation by a k-d partition tree.

Rows without a value look for the nearest rows that hold one. Pairing every such row with every
donor is quadratic, so donors and queries are cut into the leaves of one tree first: every node with too many
rows is split at the quantiles of its widest coordinate, level by level, until a leaf's rows fit
``LEAF_BYTES``. Rows with the same missing coordinates have a root of their own, as distances to them
are scaled alike.

The queries of a leaf first meet the donors of the same leaf. That bounds how far their neighbours can
be; with this bound they go down the tree, nodes before their children, and leave out each node whose
box lies beyond. Leaves that are left are compared in full, so the answer is the one a full comparison
gives. The tree is a table: nothing here grows with the data outside of tables, and a task holds two
leaves at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .schema import q
from .sizing import match, measured, small

LEAF_BYTES = 128 << 10
#: Children of a node, and shares of a hot vector's donors that are reduced apart.
FAN = 16
SALTS = 64
_QUERIES_AT_ONCE = 512
#: Pairs of a leaf and a node that a task bounds.
_MET_AT_ONCE = 1_000_000


def _vector(features: list[str]) -> Column:
    x = [F.col(q(f)).cast("double") for f in features]
    return F.array(*[F.when(F.abs(v) < float("inf"), v) for v in x])


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _pattern(size: int) -> Column:
    """One bit per coordinate that is there."""
    return _sum([F.when(F.get("vec", F.lit(i)).isNotNull(), 1 << i).otherwise(0) for i in range(size)])


def partition_tree(points: DataFrame, size: int, leaf_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """``points`` (with ``asks``: a query) with their ``node``, all nodes, and the number of levels.

    Nodes have ``node, parent, leaf`` and count and box of their donors (``d_n, d_low, d_high``) and of their queries
    (``low, high``). Splits are approximate quantiles of the coordinate with the widest range; where one value
    fills nearly all of a node, its middle. A node whose points are all equal is a leaf.
    """
    x = [F.get("vec", F.lit(i)) for i in range(size)]
    shares = [i / FAN for i in range(1, FAN)]
    open_points = points.withColumn("pattern", _pattern(size))
    open_points = cut(open_points.withColumn("node", F.col("pattern").cast("string")).withColumn("parent", F.lit(None).cast("string")))
    closed, nodes = [], []
    while True:
        asked, given = [[F.when(c, v) for v in x] for c in (F.col("asks"), ~F.col("asks"))]
        seen = open_points.groupBy("node").agg(
            F.first("parent").alias("parent"),
            F.count_if("asks").alias("q_n"),
            F.count_if(~F.col("asks")).alias("d_n"),
            F.array(*[F.min(v) for v in asked]).alias("low"),
            F.array(*[F.max(v) for v in asked]).alias("high"),
            F.array(*[F.min(v) for v in given]).alias("d_low"),
            F.array(*[F.max(v) for v in given]).alias("d_high"),
            F.array(*[F.percentile_approx(v, shares, 1000) for v in x]).alias("at"),
        )
        bottom = F.zip_with("low", "d_low", lambda a, b: F.least(a, b))
        top = F.zip_with("high", "d_high", lambda a, b: F.greatest(a, b))
        spans = F.zip_with(top, bottom, lambda h, lo: F.coalesce(h - lo, F.lit(0.0)))
        seen = seen.withColumn("axis", (F.array_position(spans, F.array_max(spans)) - 1).cast("int"))
        leaf = (F.greatest("q_n", "d_n") <= leaf_rows) | (F.array_max(spans) <= 0)
        lo, hi = F.get(bottom, F.col("axis")), F.get(top, F.col("axis"))
        useful = F.array_distinct(F.filter(F.get("at", F.col("axis")), lambda v: v < hi))
        middle = lo + (hi - lo) / 2
        cuts = F.when(F.size(useful) > 0, useful).otherwise(F.array(F.when(middle < hi, middle).otherwise(lo)))
        seen = cut(seen.withColumn("leaf", leaf).withColumn("cuts", cuts).drop("at", "q_n"))
        nodes.append(seen.drop("axis", "cuts"))
        known = small(seen.select(F.col("node").alias("of"), "leaf", "axis", "cuts"))
        placed = open_points.join(known, F.col("node") == F.col("of")).drop("of")
        closed.append(placed.where("leaf").drop("leaf", "axis", "cuts", "parent"))
        if seen.where("not leaf").isEmpty():
            return reduce(DataFrame.unionByName, closed), reduce(DataFrame.unionByName, nodes), len(nodes)
        here = F.get("vec", F.col("axis"))
        child = F.size(F.filter("cuts", lambda c: c < here)).cast("string")
        below = placed.where("not leaf").withColumn("parent", F.col("node")).withColumn("node", F.concat_ws("/", "node", child))
        open_points = cut(below.drop("leaf", "axis", "cuts"))


def _bounded(met: DataFrame, size: int, total: int) -> DataFrame:
    """Smallest and largest squared distance ``near`` and ``far`` between the boxes (low, high) and (d_low, d_high).

    Boxes without a common coordinate are left out. As Spark expressions over all coordinates the bounds
    make a method too long for the JVM to compile.
    """
    kept = ["block", "donor_node", "leaf", "d_n", "bound"]

    def measure(batches):
        for batch in batches:
            boxes = [batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("low", "high", "d_low", "d_high")]
            ql, qh, dl, dh = [x.astype(float, copy=False).reshape(-1, size) for x in boxes]
            both = ~np.isnan(ql) & ~np.isnan(dl)
            gap = np.maximum(0.0, np.maximum(dl - qh, ql - dh))
            span = np.maximum(qh - dl, dh - ql)
            some = both.sum(axis=1)
            scale = total / np.maximum(some, 1)
            bounds = [pa.array(np.where(both, x * x, 0.0).sum(axis=1) * scale) for x in (gap, span)]
            found = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *bounds], names=[*kept, "near", "far"])
            yield found.filter(pa.array(some > 0))

    schema = "block string, donor_node string, leaf boolean, d_n long, bound double, near double, far double"
    return met.select(*kept, "low", "high", "d_low", "d_high").mapInArrow(measure, schema)


def _reach(blocks: DataFrame, nodes: DataFrame, levels: int, size: int, total: int, k: int) -> DataFrame:
    """``(block, donor_node)`` of all donor leaves that can hold a neighbour of a leaf's queries.

    ``blocks`` has the distance ``bound`` known so far (null: none). Going down, the largest distance to
    nodes that together hold ``k`` rows is a bound as well. Leaves met on the way stay: their rows count.
    """
    donors = nodes.where("d_n > 0").select(F.col("node").alias("donor_node"), "parent", "leaf", "d_n", "d_low", "d_high")
    boxes, known = small(blocks), small(donors)
    names = [r[0] for r in donors.where("parent is null").select("donor_node").collect()]  # one per pattern
    roots = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    at = blocks.select("block", F.explode(roots).alias("donor_node"))
    upto = Window.partitionBy("block").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    # the rows are short, the work on them is not: a task per core, and more for many rows
    cores, rows = blocks.sparkSession.sparkContext.defaultParallelism, blocks.count() * len(names)
    for level in range(levels):
        met = at.repartition(max(cores, rows // _MET_AT_ONCE), "block").join(boxes, "block").join(known.drop("parent"), "donor_node")
        met = _bounded(met, size, total).withColumn("upto", F.sum("d_n").over(upto))
        enough = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(Window.partitionBy("block"))
        # the margin covers rounding in the bounds; least() passes over nulls
        radius = F.coalesce(F.least("bound", enough), F.lit(float("inf"))) * (1 + 1e-9) + 1e-12
        # read twice by the next level
        kept = cut(met.withColumn("radius", radius).where("near <= radius").select("block", "donor_node", "leaf"))
        if level + 1 < levels:
            rows = kept.count() * FAN  # at most
            below = known.select(F.col("parent").alias("up"), F.col("donor_node").alias("down")).where("up is not null")
            down = kept.where("not leaf").withColumnRenamed("donor_node", "up").join(below, "up")
            at = kept.where("leaf").drop("leaf").unionByName(down.select("block", F.col("down").alias("donor_node")))
    return kept.drop("leaf")


def _packed(points: DataFrame, donors: bool) -> DataFrame:
    """One row per leaf: its points side by side (a missing coordinate as NaN), donors by key."""
    x = F.transform("vec", lambda v: F.coalesce(v, F.lit(float("nan"))))
    if not donors:
        rows = F.array_sort(F.collect_list(F.struct(x.alias("x"))))
        return points.groupBy("node").agg(F.first("pattern").alias("pattern"), rows.alias("r")).select(
            F.col("node").alias("block"), "pattern", F.flatten("r.x").alias("x")
        )
    rows = F.array_sort(F.collect_list(F.struct("key", "value", x.alias("x"))))
    return points.groupBy("node").agg(F.first("pattern").alias("d_pattern"), rows.alias("r")).select(
        F.col("node").alias("donor_node"), "d_pattern", F.col("r.key").alias("keys"), F.col("r.value").alias("given"),
        F.flatten("r.x").alias("d_x"),
    )


def _compare(pairs: DataFrame, size: int, total: int, k: int, key_type: str) -> DataFrame:
    """``(block, place, distance, key, value)``: of every pair of leaves the ``k`` nearest donors of every query
    within its bound ``limits`` (null: none)."""

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                common = row["pattern"].as_py() & row["d_pattern"].as_py()
                axes = [a for a in range(size) if common >> a & 1]
                a = row["x"].values.to_numpy(zero_copy_only=False).reshape(-1, size)
                b = row["d_x"].values.to_numpy(zero_copy_only=False).reshape(-1, size)
                limits = row["limits"].values
                limit = np.full(len(a), np.inf) if limits is None else limits.to_numpy(zero_copy_only=False).astype(float)
                limit = np.where(np.isnan(limit), np.inf, limit)
                for start in range(0, len(a), _QUERIES_AT_ONCE):
                    part = a[start : start + _QUERIES_AT_ONCE]
                    summed = np.zeros((len(part), len(b)))
                    for axis in axes:
                        summed += (part[:, axis, None] - b[None, :, axis]) ** 2
                    distance = summed * total / len(axes)
                    most = limit[start : start + len(part)]
                    if len(b) > k:
                        most = np.minimum(most, np.partition(distance, k - 1, axis=1)[:, k - 1])
                    at, donor = np.nonzero(distance <= most[:, None])
                    order = np.lexsort((donor, distance[at, donor], at))  # donors are in the order of their keys
                    at, donor = at[order], donor[order]
                    first = np.searchsorted(at, at)
                    near = np.arange(len(at)) - first < k
                    at, donor = at[near], donor[near]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["block"].as_py()] * len(at)), pa.array(at + start, pa.int32()),
                                pa.array(distance[at, donor]), row["keys"].values.take(pa.array(donor)), row["given"].values.take(pa.array(donor)),
                            ],
                            names=["block", "place", "distance", "key", "value"],
                        )

    schema = f"block string, place int, distance double, key {key_type}, value double"
    columns = pairs.select("block", "pattern", "x", "limits", "d_pattern", "keys", "given", "d_x")
    # a row is two leaves: few of them at a time
    return columns.mapInArrow(search, schema)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every query, ties by key."""
    listed = F.slice(F.array_sort(F.collect_list(F.struct("distance", "key", "value"))), 1, k)
    return found.groupBy("block", "place").agg(listed.alias("near"))


def knn_impute(df: DataFrame, key: str, col: str, features: list[str], k: int, out: str, leaf_rows: int | None = None) -> DataFrame:
    """Add ``out``: the value of ``col``, or the mean over its ``k`` nearest holders (ties by key).

    Rows with the same features share one search. Of donors with the same features only the
    ``k`` smallest keys are kept, because no other one can be among the ``k`` nearest.
    """
    size, total = len(features), len(features) + 1
    leaf_rows = leaf_rows or max(64, LEAF_BYTES // (8 * (size + 4)))
    rows = df.withColumn("__vec", _vector(features))
    holds = F.col(q(col)).isNotNull()
    all_donors = rows.where(holds).select(
        F.col("__vec").alias("vec"), F.col(q(key)).alias("key"), F.col(q(col)).cast("double").alias("value")
    )
    key_type = dict(all_donors.dtypes)["key"]
    # few vectors have more than k donors; those are told by a hash and reduced in shares first
    mark = F.xxhash64("vec")
    crowded = measured(all_donors.groupBy(mark.alias("mark")).count().where(F.col("count") > k).select("mark"))
    marked = all_donors.withColumn("__mark", mark)
    donors = marked.join(crowded, F.col("__mark") == F.col("mark"), "left_semi").withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    for part in (["vec", "salt"], ["vec"]):
        first = Window.partitionBy(*part).orderBy("key")
        donors = donors.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).drop("__r")
    donors = donors.drop("salt").unionByName(marked.join(crowded, F.col("__mark") == F.col("mark"), "left_anti")).drop("__mark")
    queries = rows.where(~holds).select(F.col("__vec").alias("vec")).distinct()
    points = donors.withColumn("asks", F.lit(False)).unionByName(
        queries.withColumn("asks", F.lit(True)), allowMissingColumns=True
    )
    points, nodes, levels = partition_tree(points, size, leaf_rows)
    leaves, packed = cut(_packed(points.where("not asks"), True)), cut(_packed(points.where("asks"), False))

    home = packed.join(leaves, F.col("block") == F.col("donor_node")).withColumn("limits", F.lit(None).cast("array<double>"))
    near = _nearest(_compare(home, size, total, k, key_type), k)
    # the k-th distance of every query bounds its search, the largest one that of its leaf
    kth = F.when(F.size("near") == k, F.element_at("near", -1)["distance"])
    limits = near.groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", kth.alias("d")))), lambda r: r["d"]).alias("limits"),
        F.when(F.count(kth) == F.count(F.lit(1)), F.max(kth)).alias("bound"),
    )
    limits = cut(limits)
    blocks = nodes.where("leaf").select(F.col("node").alias("block"), "low", "high").join(packed.select("block"), "block")
    blocks = cut(blocks.join(limits.select("block", "bound"), "block", "left"))
    reach = _reach(blocks, nodes, levels, size, total, k)
    pairs = packed.join(limits.select("block", "limits"), "block", "left").join(reach, "block").join(leaves, "donor_node")
    found = _nearest(_compare(pairs, size, total, k, key_type), k)
    mean = F.aggregate("near", F.lit(0.0), lambda s, r: s + r["value"]) / F.size("near")
    vectors = packed.select("block", F.posexplode(F.sequence(F.lit(0), F.size("x") - 1, F.lit(size))).alias("place", "at"), "x")
    vectors = vectors.select(
        "block", "place", F.transform(F.slice("x", F.col("at") + 1, size), lambda v: F.when(~F.isnan(v), v)).alias("__vec")
    )
    means = vectors.join(found.select("block", "place", mean.alias("__mean")), ["block", "place"]).select("__vec", "__mean")
    overall = all_donors.agg(F.avg("value")).scalar()
    missing = match(rows.where(~holds), measured(means), ["__vec"], "left").withColumn(out, F.coalesce("__mean", overall))
    known = rows.where(holds).withColumn(out, F.col(q(col)).cast("double"))
    columns = [F.col(q(c)) for c in df.columns] + [F.col(out)]
    return known.select(*columns).unionByName(missing.select(*columns))
