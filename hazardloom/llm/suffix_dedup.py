"""Repeated passages by sparse suffix arrays.

Of all word positions only content-selected minimisers are kept: the smallest hash of ``GRAM`` words in
every stretch of ``SPAN`` positions. Any passage of ``LEAST`` words holds a minimiser among its first
``SPAN`` positions, so two copies of it hold suffixes at the same place that agree on the next
``PREFIX = LEAST - SPAN + 1`` words. Suffixes are sorted by the hash of these words and neighbours are compared;
a suffix without an equal neighbour cannot lie in a repeated passage. The others are extended to the
left and right: all runs of ``LEAST`` words that hold the suffix at one of its first ``SPAN`` places are
hashed, runs found in two different texts are kept, and overlapping ones are merged into maximal spans. That
finds every word run of at least ``LEAST`` words that two documents share, and nothing else.

The sort is by (prefix, text, position), so a passage in a third of all documents spreads over many
tasks. Equal texts are compared once; a text that occurs twice is one span.

Edge cases: null and empty texts and texts under ``LEAST`` words have no span; a passage that repeats only
inside one document is no span; repeated rows count as copies; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import lists, mix, pieces
from .shared import BROADCAST_BYTES, broadcast_if_small, small_batches, stored, text_key, words

LEAST, SPAN, GRAM = 50, 20, 8
CHUNK = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

# ---- rolling hashes -----------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse), np.uint64)]), dtype=np.uint64)
    return up, down


class RunHashes:
    """Hash of any run of words, from one pass over the words' hashes."""

    def __init__(self, words_: np.ndarray):
        with np.errstate(over="ignore"):
            up, self._down = _powers(len(words_))
            mixed = mix(words_, np.uint64(1))
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * up[: len(words_)], dtype=np.uint64)])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            found = (self._sums[starts + size] - self._sums[starts]) * self._down[starts]
        return mix(found, np.uint64(size))


def minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest value in each stretch of ``span`` values (leftmost of equal ones)."""
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    if len(grams) <= span:
        return np.array([int(np.argmin(grams))])
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.unique(np.arange(len(view)) + view.argmin(1))


def suffixes(values: np.ndarray, offsets: np.ndarray, least: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, prefix hash) of the kept suffixes."""
    prefix = least - span + 1
    runs = RunHashes(values)
    docs, places = [], []
    grams = runs.at(np.arange(max(0, len(values) - gram + 1)), gram)
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a < least:
            continue
        kept = minimisers(grams[a : b - gram + 1], span)
        kept = kept[kept + prefix <= b - a]
        docs.append(np.full(len(kept), d))
        places.append(kept)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, place = np.concatenate(docs), np.concatenate(places)
    return doc, place, runs.at(offsets[doc] + place, prefix)


def run_starts(places: np.ndarray, words_in: int, least: int, span: int) -> np.ndarray:
    """Starts of the runs of ``least`` words that hold one of ``places`` among their first ``span`` words."""
    starts = (places[:, None] - np.arange(span)[None, :]).reshape(-1)
    return np.unique(starts[(starts >= 0) & (starts + least <= words_in)])


def merged(starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the union of runs; ``starts`` ascending."""
    new = np.concatenate([[True], starts[1:] > starts[:-1] + least]) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return starts[first], starts[last] + least


# ---- Spark --------------------------------------------------------------------------------------


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def kept_suffixes(docs: DataFrame, text: str, least: int, span: int, gram: int) -> DataFrame:
    """Stored: (prefix, code, pos); ``code`` is a 64-bit stand-in for the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, CHUNK):
                values, offsets = lists(piece, 1)
                codes = np.asarray(piece.column(0))
                doc, place, prefix = suffixes(values, offsets, least, span, gram)
                yield pa.record_batch(
                    [pa.array(prefix.view(np.int64)), pa.array(codes[doc]), pa.array(place.astype(np.int32))],
                    names=["prefix", "code", "pos"],
                )

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # so many words need so many characters; a filter on the hashes would compute them twice
    rows = docs.where(F.length(t) >= 2 * least - 1).select(F.xxhash64(t).alias("code"), _word_hashes(t).alias("w"))
    return stored(rows.mapInArrow(task, "prefix long, code long, pos int"), "sparse-suffixes")


def repeated_suffixes(suffix: DataFrame) -> DataFrame:
    """(code, pos) of the suffixes with an equal neighbour in sorted order.

    The first and last suffix of a task are kept as well, as their neighbours are in other tasks; the
    extension drops what has no partner.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (prefix, code, pos, equal to the one before) of the last suffix so far
        first = True
        for batch in batches:
            prefix, code, pos = (np.asarray(batch.column(i)) for i in range(3))
            if not len(prefix):
                continue
            before = np.zeros(len(prefix), bool)
            if held is not None:
                prefix, code, pos = (np.concatenate([[h], x]) for h, x in zip(held[:3], (prefix, code, pos)))
                before = np.concatenate([[held[3]], before])
            # copies of a text bring the same suffix again
            new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (code[1:] != code[:-1]) | (pos[1:] != pos[:-1])])
            prefix, code, pos, before = prefix[new], code[new], pos[new], before[new]
            equal = prefix[1:] == prefix[:-1]
            before[1:] |= equal
            if first:
                before[0], first = True, False
            shared = before.copy()
            shared[:-1] |= equal
            held = (prefix[-1], code[-1], pos[-1], bool(before[-1]))
            out = np.flatnonzero(shared[:-1])
            yield pa.record_batch([pa.array(code[:-1][out]), pa.array(pos[:-1][out].astype(np.int32))], names=["code", "pos"])
        if held is not None:
            yield pa.record_batch([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32())], names=["code", "pos"])

    ordered = suffix.repartitionByRange("prefix", "code", "pos").sortWithinPartitions("prefix", "code", "pos")
    return ordered.mapInArrow(task, "code long, pos int")


def spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, span: int = SPAN, gram: int = GRAM
) -> DataFrame:
    """One row per document and maximal span of word runs shared with another document: key,
    ``start_word``, ``end_word`` (exclusive) and ``n_words`` of the span."""
    if not 0 < gram <= least - span + 1:
        raise ValueError("a passage must be longer than the span and the gram")
    small_batches(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    shared = repeated_suffixes(kept_suffixes(docs, text, least, span, gram))
    places = stored(shared.groupBy("code").agg(F.collect_set("pos").alias("places")), "suffix-places")
    # positions per text vary widely, so their real bytes are summed
    held = places.agg(F.sum(F.size("places") * 4 + 48)).first()[0] or 0
    wanted = F.broadcast(places) if held <= BROADCAST_BYTES else places

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, CHUNK):
                values, offsets = lists(piece, 1)
                runs = RunHashes(values)
                found = piece.column(2)
                starts, n = [], []
                for d in range(piece.num_rows):
                    at = np.asarray(found[d].values, np.int64)
                    s = run_starts(at, int(offsets[d + 1] - offsets[d]), least, span)
                    starts.append(s + offsets[d])
                    n.append(len(s))
                where = np.concatenate(starts)
                doc = np.repeat(np.arange(piece.num_rows), n)
                for a in range(0, len(where), CHUNK):
                    w, d = where[a : a + CHUNK], doc[a : a + CHUNK]
                    yield pa.record_batch(
                        [piece.column(0).take(pa.array(d)), pa.array(runs.at(w, least).view(np.int64)),
                         pa.array((w - offsets[d]).astype(np.int32))],
                        names=["k", "run", "start"],
                    )

    texts = docs.select(text_key(t).alias("k"), F.xxhash64(t).alias("c"), t.alias("t"))
    texts = texts.join(wanted, F.col("c") == F.col("code")).select("k", _word_hashes(F.col("t")).alias("w"), "places")
    runs = texts.mapInArrow(extend, "k binary, run long, start int")
    runs = stored(runs.withColumn("code", F.xxhash64("k")), "candidate-runs")
    repeated = runs.groupBy("run").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).where("lo <> hi").select("run")
    hits = runs.join(repeated, "run", "left_semi").groupBy("k").agg(F.sort_array(F.collect_set("start")).alias("starts"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merged(np.asarray(x.values, np.int64), least) for x in batch.column(1)]
            n = [len(s) for s, _ in found]
            if sum(n):
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                     pa.array(np.concatenate([s for s, _ in found])), pa.array(np.concatenate([e for _, e in found]))],
                    names=["k", "start_word", "end_word"],
                )

    parts = hits.mapInArrow(join_up, "k binary, start_word long, end_word long")
    ids = docs.select(F.col(f"`{key}`").alias("id"), text_key(t).alias("tk"), F.size(words(t)).cast("long").alias("n"))
    copied = ids.where(F.col("n") >= least).groupBy(F.col("tk").alias("k"), "n").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    whole = stored(copied.select("k", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word")), "whole-spans")
    parts = parts.join(broadcast_if_small(whole.select("k"), 60), "k", "left_anti").union(whole)
    parts = broadcast_if_small(stored(parts, "spans"), 60)
    return ids.join(parts, F.col("tk") == F.col("k")).select(
        F.col("id").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words")
    )

