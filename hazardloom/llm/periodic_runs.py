"""Periodic runs of words: stretches that repeat one unit several times, found by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period ``q`` that no neighbouring word
extends and that is at least ``max(min_words, exponent * q)`` words long. All suffixes of a text start
as classes of their own. Pairs of suffixes that are neighbours in suffix order are united by
decreasing longest common prefix (LCP), each class keeping its positions in order. Two positions
``i < j`` that become neighbours in a class at a common prefix of ``l >= j - i`` words repeat the unit of
``j - i`` words; ``j - i`` is then the smallest period (a smaller one would have put a position
between them at a greater LCP), the stretch ends exactly at ``j + l``, and it is a run if the words
before ``i`` and ``j`` differ. Of each run the leftmost such pair is taken, so every run is found once.

One text is handled within one task; texts are dealt over the tasks as they are read, without a
shuffle. Memory is bounded by the longest text of a task (some 100 bytes a word). Texts in which
no sequence of as many words as the least seed occurs twice have no run and are settled by one sort.

Null and empty texts have no words and no runs. Very long texts are read whole; a text that repeats
one word costs ``n log n``. Ties do not arise: runs are listed by start, then period. Repeated rows
give repeated results, an empty table an empty one; columns other than the two read are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import let, small_batches, words

MIN_WORDS = 6
EXPONENT = 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def least_seed(min_words: int, exponent: int) -> int:
    """The shortest common prefix with which a run can start: its length without one period."""
    return min(max(min_words - q, (exponent - 1) * q) for q in range(1, min_words + 1))


def word_numbers(found: list[bytes]) -> np.ndarray:
    """Each word as the place of its first occurrence."""
    return np.fromiter(map({}.setdefault, found, count()), np.int64, len(found))


def repeats(numbers: np.ndarray, size: int) -> bool:
    """False only if no ``size`` consecutive words occur twice (compares 64-bit hashes)."""
    n = len(numbers) - size + 1
    if n < 2:
        return False
    mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + n]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def suffix_order(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the LCP of each with its successor, by prefix doubling."""
    n = len(numbers)
    rank = np.unique(numbers, return_inverse=True)[1]
    levels, width = [], 1
    while True:
        levels.append((width, rank.astype(np.int32)))
        if rank.max() == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        width *= 2
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for width, rank in reversed(levels):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[rank[a[inside]] == rank[b[inside]]]
        for moved in (a, b, lcp):
            moved[same] += width
    return order, lcp


def runs_of(numbers: np.ndarray, min_words: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text, by start and period."""
    seed = least_seed(min_words, exponent)
    if not repeats(numbers, seed):
        return []
    order, lcp = suffix_order(numbers)
    edges = np.flatnonzero(lcp >= seed)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    # classes are named by a position; ``home`` leads there, ``members`` has their positions in order
    home: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []

    def class_of(x: int) -> int:
        while (up := home.setdefault(x, x)) != x:
            home[x] = x = home.setdefault(up, up)
        return x

    def meet(i: int, j: int, common: int) -> None:
        period = j - i
        if period * (exponent - 1) <= common and common + period >= min_words:
            if i == 0 or numbers[i - 1] != numbers[j - 1]:
                found.append((i, common + period, period))

    for left, right, common in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist()):
        x, y = class_of(left), class_of(right)
        large, small = members.pop(x, [x]), members.pop(y, [y])
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        before = -1
        for k, at in enumerate(small):
            gap = bisect_left(large, at)
            if gap and large[gap - 1] > before:
                meet(large[gap - 1], at, common)
            if gap < len(large) and (k + 1 == len(small) or small[k + 1] > large[gap]):
                meet(at, large[gap], common)
            before = at
        if len(small) * 8 < len(large):
            for at in small:
                insort(large, at)
        else:
            large = sorted(large + small)
        home[y] = x
        members[x] = large
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapse(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of repetitions: of every run only the first unit is kept."""
    if runs:
        kept = np.ones(len(found), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        found = [found[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(found)


def find(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words) and the collapsed text of every row."""
    small_batches(docs.sparkSession)

    def scan(batches):
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for text in batch.column(1):
                found = (text.as_py() or b"").split()  # ASCII white space, as the word rule has it
                own = runs_of(word_numbers(found), min_words, exponent)
                sizes.append(len(found))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                collapsed.append(collapse(found, own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.select("doc_id").dtypes[0][1]
    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = read.mapInArrow(scan, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Rewrite a tenth of the texts so that their tails repeat, for measuring the search.

    The checksum ``h`` of the id decides: where ``h % 10`` is 0, words from ``a`` on repeat the unit
    of ``p`` words that starts there. Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        source = F.transform(at, lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.concat_ws(" ", F.transform(source, lambda i: F.get(w, i.cast("int"))))

    tail = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when(h % 10 == 0, tail).otherwise(F.col("text")).alias("text"))


def best(runs: Column) -> Column:
    """The run of greatest exact length/period; of equal ones that with the smallest start, then period."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when((y > x) | (a["period"].isNull()), b).otherwise(a)

    none = F.lit(None).cast(RUNS[6:-1])
    return F.aggregate(runs, none, better)


def summary(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    top = found.withColumn("top", best(F.col("runs")))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
