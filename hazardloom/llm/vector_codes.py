"""Compressed vector codes: product codebooks in integers, searched by Orchard's method.

Components become ``floor(256 * x)``; a vector is cut into equal consecutive parts, each part position
has a codebook of its own. The nearest entry is found by Orchard's search: every entry has
the list of all entries by distance to it; the list of the current best entry is read in order,
a better entry makes its own list the current one, entries that were compared are marked and skipped, and the
search ends where list entries lie more than twice as far from the current entry as the point does (by
the triangle inequality nothing beyond can be nearer). All comparisons are exact integers and ties
go to the lower index, so the result equals a full comparison.

Every round reads all vectors and sums in the tasks: one row per task and codebook component is
shuffled. Only codebooks (``entries`` times the vector's length) come to the driver and go to
the tasks; they don't grow with the table. Tasks hold one Arrow batch at a time.

Rows whose vector is null or has null or non-finite components are dropped. The length is that of the kept vector with
the smallest id whose length the parts divide; kept vectors of another length, and those with a
component so large that squared distances leave 64 bits (beyond some 370,000 at 64 components),
come back with null code and error. The first entries are the vectors with the smallest ids, ties
ordered by their components, null ids last; a table of fewer vectors has smaller
codebooks. Repeated rows count and come back as often as they are there; an empty table gives an empty
result; other columns are ignored. There are no texts; very long vectors are only wider parts.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import broadcast_if_small, stored

PARTS = 16
ENTRIES = 64  # at most 256, codes are written as two hex digits
ROUNDS = 2
SCALE = 256


@dataclass(frozen=True)
class Codebooks:
    """``books[part, entry, position]``; no entries if there was no vector to start from."""

    books: np.ndarray

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def digest(self) -> str:
        listed = ",".join(map(str, self.books.ravel().tolist()))
        return hashlib.sha256(listed.encode()).hexdigest()


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry all entries by distance to it, and these squared distances."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    lists = np.argsort(apart, axis=1, kind="stable")
    return lists, np.take_along_axis(apart, lists, 1)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every point (lowest index of equals) and its squared distance."""
    lists, apart = neighbour_lists(book)
    size = len(book)
    # start at an entry that is near in the widest coordinate
    axis = int(np.argmax(book.max(0) - book.min(0)))
    by_axis = np.argsort(book[:, axis], kind="stable")
    at = np.searchsorted(book[by_axis, axis], points[:, axis])
    entry = by_axis[np.minimum(at, size - 1)]
    best = ((points - book[entry]) ** 2).sum(1)
    marked = np.zeros((len(points), size), bool)
    marked[np.arange(len(points)), entry] = True
    step = np.zeros(len(points), np.int64)
    active = np.arange(len(points))
    while len(active):
        active = active[step[active] < size]
        here, k = entry[active], step[active]
        within = apart[here, k] <= 4 * best[active]
        active, here, k = active[within], here[within], k[within]
        step[active] += 1
        other = lists[here, k]
        fresh = ~marked[active, other]
        rows, other = active[fresh], other[fresh]
        marked[rows, other] = True
        found = ((points[rows] - book[other]) ** 2).sum(1)
        better = (found < best[rows]) | ((found == best[rows]) & (other < entry[rows]))
        moved = rows[better]
        entry[moved], best[moved], step[moved] = other[better], found[better], 0
    return entry, best


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and integer components ``v`` of the rows whose vector is whole and finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & ~bad)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return kept.select("vec_id", "label", whole.alias("v"))


def _fits(dims: int):
    """Rows that the codebooks can encode: the right length, distances within 64 bits."""
    most = math.isqrt((2**63 - 1) // (16 * dims)) if dims else 0
    return (F.size("v") == dims) & F.forall("v", lambda x: x.between(-most, most))


def _cut(column: pa.ListArray, parts: int, width: int) -> np.ndarray:
    """The vectors that are there as (vector, part, position)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)


def fit(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks:
    """Codebooks from all vectors: the first ``entries`` vectors, moved to their members' means ``rounds`` times."""
    found = quantised(vectors)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    divided = found.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = divided.orderBy(*order).select(F.size("v")).head()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    dims = first[0]
    width = dims // parts
    usable = found.where(_fits(dims))
    start = [r["v"] for r in usable.orderBy(*order).limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if start else 0):  # none if all components are too large
        books = _moved(usable, books)
    return Codebooks(books)


def _moved(usable: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the floored mean of the parts that are nearest to it; unused entries as they are."""
    parts, size, width = books.shape

    def sums(batches):
        total = np.zeros((parts, size, width + 1), np.int64)  # the last one counts
        for batch in batches:
            v = _cut(batch.column(0), parts, width)
            for p in range(parts):
                entry, _ = nearest(v[:, p], books[p])
                np.add.at(total[p, :, :width], entry, v[:, p])
                total[p, :, width] += np.bincount(entry, minlength=size)
        used = np.flatnonzero(total[:, :, width].ravel())
        rows = total.reshape(parts * size, width + 1)[used]
        slots = (used[:, None] * (width + 1) + np.arange(width + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(rows.ravel())], names=["slot", "total"])

    partial = usable.select("v").mapInArrow(sums, "slot long, total long")
    totals = np.zeros(parts * size * (width + 1), object)
    for slot, total in partial.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        totals[slot] = total
    totals = totals.reshape(parts, size, width + 1)
    moved = books.copy()
    for p, e in zip(*np.nonzero(totals[:, :, width])):
        moved[p, e] = [x // totals[p, e, width] for x in totals[p, e, :width]]
    return moved


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error (squared distances over all parts) of every kept row."""
    books = codebooks.books
    parts, size, width = books.shape
    found = quantised(vectors)
    kinds = dict(found.dtypes)
    read = found.withColumn("v", F.when(_fits(parts * width), F.col("v"))) if size else found.withColumn("v", F.lit(None).cast(kinds["v"]))

    def codes(batches):
        for batch in batches:
            there = np.asarray(batch.column(2).is_valid())
            v = _cut(batch.column(2), parts, width) if there.any() else None
            code, error = np.full(len(there), None, object), np.zeros(len(there), np.int64)
            if v is not None:
                digits, far = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
                for p in range(parts):
                    entry, apart = nearest(v[:, p], books[p])
                    digits[:, p] = entry
                    far += apart
                text, step = digits.tobytes().hex(), 2 * parts
                code[there] = [text[i : i + step] for i in range(0, len(text), step)]
                error[there] = far
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=~there)],
                names=["vec_id", "label", "code", "error"],
            )

    return read.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the error summed over equal labels (nulls are one label; null where the sum leaves 64 bits)."""
    kept = stored(coded, "vector-codes")
    per = stored(kept.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    per = broadcast_if_small(per.withColumnRenamed("label", "of_label"), 64)
    return kept.join(per, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("label", "of_label")
