"""Order-dependent operators that survive one huge group.

A plain window puts each partition key into one task, so a key that owns a third of the rows
decides the run time. Here a group with too many rows for one task is cut by radix selection: its rows are
counted by the first order key (by quantiles of a number, by the first character in which texts
differ), children with too many rows are counted by what comes next, down to leaves that fit; rows
that are equal in every key are dealt out by their place in the input. Windows run inside leaves, and
what a leaf's predecessors in the count tree contribute arrives as a carry. The input is stored
once; nothing is sampled, and the leaf size follows from the rows' bytes and the cores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut
from .sizing import match, measured, row_bytes, small

#: A leaf holds at most the first, and at least the second number of bytes, if the rows allow it.
MOST_BYTES = 64 << 20
LEAST_BYTES = 16 << 20
#: Children of a node that is cut by a number's quantiles.
FAN = 32
_CHILD = "__path"


def leaf_size(rows: int, size: float, cores: int) -> int:
    """Rows of a leaf: enough leaves for all cores, none larger than a task should hold."""
    share = min(MOST_BYTES, max(LEAST_BYTES, rows * size / (2 * cores)))
    return max(1, int(share / max(size, 1)))


def _below(values: str, limit: Column) -> Column:
    return F.filter(values, lambda v: v < limit)


class OrderedRows:
    """Rows in a total order inside groups: ``by`` columns, then ``order`` (ascending).

    ``order`` holds columns or expressions; negate a number to sort it descending. Without ``by``
    there is one global group. Nulls come first. ``rows_per_bucket`` sets the leaf size itself.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list, rows_per_bucket: int | None = None):
        self.by = list(by)
        keys = [c if isinstance(c, Column) else F.col(c) for c in order]
        self._order = [f"__o{i}" for i in range(len(keys))]
        kinds = df.select(*keys).schema.fields
        # flags and bytes in a form that can be cut, in the same order
        keys = [
            k.cast("int") if isinstance(f.dataType, T.BooleanType) else F.hex(k) if isinstance(f.dataType, T.BinaryType) else k
            for k, f in zip(keys, kinds)
        ]
        keyed = df.withColumns(dict(zip(self._order, keys))).withColumn("__id", F.monotonically_increasing_id())
        #: the input with its keys, written once; everything is counted and summed there
        self.stored = base = cut(keyed)
        self.count, size = base.count(), base.limit(1000).agg(F.avg(row_bytes(base))).first()[0]
        most = rows_per_bucket or leaf_size(self.count, size or 1.0, df.sparkSession.sparkContext.defaultParallelism)
        self._base = base.withColumn(_CHILD, F.array().cast("array<bigint>"))
        self._split = self.count > most and self._cut_large(base, most)
        self._rows, self._inner = self._base, [_CHILD, "__id", *self._order]
        self._frames()

    def _frames(self) -> None:
        group = Window.partitionBy(*self.by, _CHILD)
        start = Window.unboundedPreceding
        self._upto = group.orderBy(*self._order).rowsBetween(start, 0)
        # looking ahead reads the leaf backwards: a frame that ends at the last row would be
        # evaluated anew for every row
        self._back = group.orderBy(*[F.col(c).desc() for c in self._order]).rowsBetween(start, 0)

    def _cut_large(self, base: DataFrame, most: int) -> bool:
        """Give the rows of over-full groups their leaf's path; other groups stay whole."""
        if self.by:
            counts = base.groupBy(*self.by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
            # fewer groups than leaves, numbered in one task
            number = F.row_number().over(Window.orderBy(*self.by))
            large = cut(counts.withColumn("__root", number.cast("bigint")).drop("__n"))
            if large.isEmpty():
                return False
            matched = match(base, small(large), self.by, "left")
            nowhere = F.array().cast("array<bigint>")
            closed = [matched.where("__root is null").withColumn(_CHILD, nowhere).drop("__root")]
            rows = matched.where("__root is not null").withColumn(_CHILD, F.array("__root")).drop("__root")
        else:
            closed, rows = [], base.withColumn(_CHILD, F.array(F.lit(1).cast("bigint")))
        while True:
            nodes = cut(self._nodes(rows, most))
            if nodes.isEmpty():
                break
            known = small(nodes.withColumnRenamed(_CHILD, "__of"))
            placed = rows.join(known, F.col(_CHILD) == F.col("__of"), "left")
            spent = [*nodes.columns[1:], "__of"]
            closed.append(placed.where("__of is null").drop(*spent))
            # rows of over-full nodes are written once per level; most are in a leaf after two
            rows = cut(placed.where("__of is not null").withColumn(_CHILD, F.concat(_CHILD, F.array(self._child()))).drop(*spent))
        self._base = reduce(DataFrame.unionByName, [*closed, rows])
        return True

    def _kinds(self, rows: DataFrame) -> list[str]:
        """How each order key is cut: by quantiles, by characters, or (anything else) not at all."""
        kinds = []
        for c in self._order:
            kind = rows.schema[c].dataType
            numeric = isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
            kinds.append("number" if numeric else "text" if isinstance(kind, T.StringType) else "other")
        return kinds

    def _nodes(self, rows: DataFrame, most: int) -> DataFrame:
        """Over-full nodes and how their rows are told apart: the first key that differs (``__axis``, -1: none),
        its cuts or the length of its common prefix, and the parts that equal rows are dealt to."""
        kinds = self._kinds(rows)
        shares = [i / FAN for i in range(1, FAN)]
        found = [F.count(F.lit(1)).alias("__n")]
        for i, (c, kind) in enumerate(zip(self._order, kinds)):
            found += [F.count(c).alias(f"__n{i}"), F.min(c).alias(f"__lo{i}"), F.max(c).alias(f"__hi{i}")]
            if kind == "number":
                found.append(F.percentile_approx(c, shares, 1000).alias(f"__at{i}"))
        stats = rows.groupBy(_CHILD).agg(*found).where(F.col("__n") > most)
        axis, columns = F.lit(-1), []
        for i, kind in reversed(list(enumerate(kinds))):
            lo, hi, some = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__n{i}")
            differs = ((some > 0) & (some < F.col("__n"))) | (lo < hi)
            if kind == "number":
                axis = F.when(differs, i).otherwise(axis)
                useful = F.array_distinct(_below(f"__at{i}", hi))
                cuts = F.when(F.size(useful) > 0, useful).otherwise(F.array(lo))
                columns.append(F.when(some > 0, cuts).alias(f"__cuts{i}"))
            elif kind == "text":
                axis = F.when(differs, i).otherwise(axis)
                same = F.zip_with(F.split(lo, ""), F.split(hi, ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
                columns.append((F.array_position(same, False) - 1).cast("int").alias(f"__skip{i}"))
            else:
                # told apart by first differing from the smallest value only
                axis = F.when(differs, i).otherwise(axis)
                columns.append(lo.alias(f"__first{i}"))
        parts = F.ceil(F.col("__n") / most).alias("__parts")
        return stats.select(_CHILD, axis.alias("__axis"), parts, *columns)

    def _child(self) -> Column:
        """A row's place among its node's children, in the order of the keys; nulls first."""
        place = F.pmod(F.xxhash64("__id", F.size(_CHILD)), F.col("__parts"))
        for i, (c, kind) in enumerate(zip(self._order, self._kinds(self._base))):
            x = F.col(c)
            if kind == "number":
                at = 1 + F.size(_below(f"__cuts{i}", x))
            elif kind == "text":
                at = 1 + F.ascii(F.substr(x, F.col(f"__skip{i}") + 1, F.lit(1)))
            else:
                at = F.when(x > F.col(f"__first{i}"), 2).otherwise(1)
            place = F.when(F.col("__axis") == i, F.when(x.isNull(), 0).otherwise(at)).otherwise(place)
        return place.cast("bigint")

    def _carry(self, summary: Column, fold, later: bool) -> DataFrame:
        """One row for every leaf of an over-full group that follows another one; one task per such group reads
        its leaves, a row for some tens of megabytes of input each."""
        per_leaf = self._base.where(F.size(_CHILD) > 0).groupBy(_CHILD).agg(summary.alias("__s"))
        position = F.col(_CHILD).desc() if later else F.col(_CHILD)
        earlier = Window.partitionBy(F.get(_CHILD, F.lit(0))).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        carried = per_leaf.withColumn("__c", fold(F.col("__s")).over(earlier))
        return carried.where(F.col("__c").isNotNull()).select(F.col(_CHILD).alias("__of"), "__c")

    def _add(self, out: str, local: Column, summary: Column, fold, combine, later=False) -> "OrderedRows":
        rows = self._rows.withColumn(out, local)
        if self._split:
            carry = measured(self._carry(summary, fold, later))
            rows = rows.join(carry, F.col(_CHILD) == F.col("__of"), "left")
            rows = rows.withColumn(out, combine(F.col(out), F.col("__c"))).drop("__c", "__of")
        self._rows = rows
        return self

    def then(self, number: str, name: str, value: Column) -> "OrderedRows":
        """Go on with a column made from results so far; ``number`` holds the row numbers found."""
        self._rows = self._base = cut(self._rows.withColumn(name, value))
        self._order = [number]
        self._frames()
        return self

    def running_sum(self, value, out: str) -> "OrderedRows":
        """Sum of ``value`` from the start of the group to this row."""
        x = value if isinstance(value, Column) else F.col(value)
        return self._add(
            out, F.sum(x).over(self._upto), F.sum(x), F.sum, lambda here, carry: here + F.coalesce(carry, F.lit(0))
        )

    def row_number(self, out: str) -> "OrderedRows":
        return self._add(
            out,
            F.count(F.lit(1)).over(self._upto),
            F.count(F.lit(1)),
            F.sum,
            lambda here, carry: here + F.coalesce(carry, F.lit(0)),
        )

    def previous(self, value: str, out: str) -> "OrderedRows":
        """Last non-null ``value`` at or before this row."""
        x = F.col(value)
        newest = F.max_by(x, F.when(x.isNotNull(), F.struct(*self._order)))
        return self._add(
            out,
            F.last(x, ignorenulls=True).over(self._upto),
            newest,
            lambda s: F.last(s, ignorenulls=True),
            lambda here, carry: F.coalesce(here, carry),
        )

    def following(self, value: str, out: str) -> "OrderedRows":
        """First non-null ``value`` at or after this row."""
        x = F.col(value)
        oldest = F.min_by(x, F.when(x.isNotNull(), F.struct(*self._order)))
        return self._add(
            out,
            F.last(x, ignorenulls=True).over(self._back),
            oldest,
            lambda s: F.last(s, ignorenulls=True),
            lambda here, carry: F.coalesce(here, carry),
            later=True,
        )

    def result(self) -> DataFrame:
        return self._rows.drop(*self._inner)


def distinct_running(df: DataFrame, by: list[str], value: str, weight: str, rows_per_bucket=None) -> DataFrame:
    """Inclusive running ``weight`` over distinct ``value`` per group (input: one row per value)."""
    return OrderedRows(df, by, [value], rows_per_bucket).running_sum(weight, "upto").result()


def average_rank(df: DataFrame, by: list[str], value: str, out: str, rows_per_bucket=None) -> DataFrame:
    """Ascending rank with ties sharing their mean rank; rows are counted per value first."""
    counts = cut(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    ranked = distinct_running(counts, by, value, "__n", rows_per_bucket).select(
        *by, value, (F.col("upto") - F.col("__n") + (F.col("__n") + 1) / F.lit(2.0)).alias(out)
    )
    return match(df, measured(ranked), [*by, value])


def competition_rank(df: DataFrame, by: list[str], value: str, out: str, rows_per_bucket=None) -> DataFrame:
    """Rank by descending ``value``, nulls last; equal values share the smallest rank."""
    counts = cut(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    order = [F.col(value).isNull(), -F.col(value)]
    ranked = OrderedRows(counts, by, order, rows_per_bucket).running_sum("__n", "upto").result()
    ranked = ranked.select(*by, value, (F.col("upto") - F.col("__n") + 1).alias(out))
    return match(df, measured(ranked), [*by, value])
