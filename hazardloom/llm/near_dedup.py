"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, exact multiset overlap.

A text is the multiset of its runs of ``SHINGLE`` words. For every distinct run, the weight axis is cut at
0, 1, 2, 4, ... and each interval has its own Poisson process, whose points carry a time, a signature
slot and a place inside the interval; a point counts if its place lies below the weight. A slot keeps the
smallest time, and a run stops as soon as its next point is later than every slot's time. Two slots
agree with the probability of the weighted Jaccard similarity.

Texts that agree on a band meet in a bucket. Equal texts are one node from the start. Every bucket
member is verified against the bucket's first and last node, by exact multiset overlap; links give
components. Buckets that still hold several components are settled exactly: among their texts, any
pair of similarity >= t shares one of its rarest runs (the prefix bound), so texts outside a bucket's first
component are joined with the others on those rare runs only, and verified. No group is expanded
into all its pairs, and no bucket is cut.

Edge cases: null, empty and blank texts have no runs and stay alone; a text of fewer than five words is
one run; repeated rows and equal texts share a class; the class id is the smallest key of the class,
null keys are ignored for it (a class of null keys only has a null id); an empty table gives an
empty result; extra columns are ignored (``keep_one`` returns them unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import lists, mix, pieces
from .shared import BROADCAST_BYTES, HAS_WORD, broadcast_if_small, shingle_hashes, small_batches, stored, text_key, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 6
CHUNK = 150_000

# ---- signatures ---------------------------------------------------------------------------------


def _counted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, run, weight) of the distinct runs of each document."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])) if len(d) else np.zeros(0, int)
    return d[first], v[first], np.diff(np.append(first, len(d)))


def signatures(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """Times per document and slot; infinite for documents without runs."""
    docs = len(offsets) - 1
    doc, run, weight = _counted(values, offsets)
    # intervals [0, 1), [1, 2), [2, 4), [4, 8), ... that begin below the weight
    parts = [(doc, run, np.zeros(len(doc)), np.ones(len(doc)), weight, 0)]
    low, number = 1, 1
    while (some := weight > low).any():
        n = int(some.sum())
        parts.append((doc[some], run[some], np.full(n, float(low)), np.full(n, float(low)), weight[some], number))
        low, number = low * 2, number + 1
    doc = np.concatenate([p[0] for p in parts])
    process = np.concatenate([mix(p[1], np.uint64(p[5])) for p in parts])
    start, length, weight = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    out = np.full(docs * slots, np.inf)
    time = np.zeros(len(doc))
    point = 0
    while len(doc):
        point += 1
        h = mix(process, np.uint64(point))
        time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        g = mix(h, np.uint64(0))
        slot = ((g >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        place = start + length * ((g & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        counts = place < weight
        np.minimum.at(out, doc[counts] * slots + slot[counts].astype(np.int64), time[counts])
        alive = time < out.reshape(docs, slots).max(1)[doc]
        doc, process, start, length, weight, time = (x[alive] for x in (doc, process, start, length, weight, time))
    return out.reshape(docs, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    # single precision, so the last digit of a logarithm on another machine does not matter
    values = sig.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands))
    for j in range(rows):
        key = mix(values[:, :, j], key)
    return key


def occurrence_tokens(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's runs made distinct by their occurrence number, sorted; multiset overlap becomes
    set overlap."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, doc))
    v = values[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])]) if len(v) else np.zeros(0, bool)
    at = np.arange(len(v))
    number = at - np.maximum.accumulate(np.where(new, at, 0)) if len(v) else at
    return mix(v, number.astype(np.uint64)), offsets


def _list_column(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


# ---- components ---------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes; the label is the smallest node of the component."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", "label", F.least("label", "m").alias("next"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("far"))
        step = step.join(jump, F.col("next") == F.col("j")).select("node", F.least("next", "far").alias("next"), "label")
        step = stored(step, "labels")
        moved = step.where("next <> label").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


# ---- Spark --------------------------------------------------------------------------------------


def _nodes(docs: DataFrame, text: str, bands: int, rows: int) -> DataFrame:
    """Stored: (k, node, n, bands) per distinct text with words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, CHUNK):
                values, offsets = lists(piece, 1)
                keys = band_keys(signatures(values, offsets, bands * rows), bands, rows)
                every = np.arange(len(keys) + 1) * bands
                yield pa.record_batch(
                    [piece.column(0), pa.array(np.diff(offsets)), _list_column(keys.reshape(-1), every)],
                    names=["k", "n", "bands"],
                )

    t = F.col(f"`{text}`")
    # the filter looks at the text: on the runs it would compute them twice
    rows_in = docs.where(t.rlike(HAS_WORD)).select(text_key(t).alias("k"), shingle_hashes(words(t), SHINGLE).alias("runs"))
    made = rows_in.mapInArrow(task, "k binary, n long, bands array<long>").dropDuplicates(["k"])
    return stored(made.withColumn("node", F.monotonically_increasing_id()), "signatures")


def _tokens(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Stored: (node, tokens) of the wanted (k, node) texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, CHUNK):
                tokens, offsets = occurrence_tokens(*lists(piece, 1))
                yield pa.record_batch([piece.column(0), _list_column(tokens, offsets)], names=["node", "tokens"])

    t = F.col(f"`{text}`")
    rows = docs.select(text_key(t).alias("tk"), t.alias("t")).join(broadcast_if_small(wanted, 60), F.col("tk") == F.col("k"))
    runs = rows.select("node", shingle_hashes(words(F.col("t")), SHINGLE).alias("runs"))
    return stored(runs.mapInArrow(task, "node long, tokens array<long>").dropDuplicates(["node"]), "run-sets")


def _verified(pairs: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    both = F.size("ta") + F.size("tb")
    # common / (both - common) >= similarity, with a margin for the division's rounding
    return met.where(common >= similarity * (both - common) - 1e-9).select("a", "b")


def _similar_sizes(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _rare_links(tokens: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links across components, found through the rarest runs; ``nodes`` has (node, comp, outside).

    Two texts of that similarity share one of the rarest runs of each (prefix bound), at places that
    leave room for the overlap (positional bound). The bounds first thin out both sides, then the
    exact overlap is part of the join's condition, so only links leave it.
    """
    own = tokens.join(nodes, "node")
    spread = own.select("node", "comp", "outside", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(often, "token").groupBy("node", "comp", "outside", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s")
    )
    length = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    prefix = ranked.select("node", "comp", "outside", "n", F.posexplode(F.slice("s", F.lit(1), length.cast("int"))).alias("at", "e"))
    prefix = stored(prefix.where("e.df > 1").select("node", "comp", "outside", "n", "e.token", "at"), "rare-runs")

    def other(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({c: f"o_{c}" for c in df.columns})

    most = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))
    fits = (
        (F.col("token") == F.col("o_token"))
        & (F.col("comp") != F.col("o_comp"))
        & _similar_sizes(F.col("n"), F.col("o_n"), similarity)
        & (most >= similarity * (F.col("n") + F.col("o_n") - most) - 1e-9)
    )
    outside = stored(prefix.where("outside").join(other(prefix), fits, "left_semi"), "rare-outside")
    facing = stored(prefix.join(other(outside), fits, "left_semi"), "rare-facing")
    common = F.size(F.array_intersect("tokens", "o_tokens"))
    exact = common >= similarity * (F.col("n") + F.col("o_n") - common) - 1e-9
    whole = outside.join(tokens, "node")
    held = outside.agg(F.sum(F.col("n") * 8 + 64)).first()[0] or 0
    # the texts outside are usually few: broadcast, a run that many texts share needs no shuffle
    whole = F.broadcast(whole) if held <= BROADCAST_BYTES else whole
    met = other(facing.join(tokens, "node")).join(whole, fits & exact)
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def linked(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(texts, labels): (k, node) of distinct texts with words, and (node, label) of linked ones."""
    small_batches(docs.sparkSession)
    nodes = _nodes(docs, text, bands, rows)
    spread = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    shared = broadcast_if_small(stored(shared, "buckets"), 40)
    members = stored(spread.join(shared, "band"), "bucket-members")
    wanted = members.select("node").distinct().join(nodes.select("node", "k"), "node")
    tokens = _tokens(docs, text, stored(wanted, "bucket-texts"))
    ends = members.select(F.least("lo", "node").alias("a"), F.greatest("lo", "node").alias("b")).union(
        members.select(F.least("hi", "node"), F.greatest("hi", "node"))
    )
    pairs = stored(ends.where("a < b").distinct(), "pairs")
    links = stored(_verified(pairs, tokens, similarity), "links")
    labels = components(links)
    comp = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("comp"))
    mixed = comp.groupBy("band").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first < last")
    mixed = broadcast_if_small(stored(mixed.select("band", "first"), "mixed-buckets"), 40)
    open_nodes = comp.join(mixed, "band").groupBy("node", "comp").agg(F.max(F.col("comp") != F.col("first")).alias("outside"))
    more = stored(_rare_links(tokens, stored(open_nodes, "open-texts"), similarity), "links")
    return nodes.select("k", "node"), components(links.union(more))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row of ``docs``: key, ``class_id`` and ``class_docs``, the rows in its class."""
    texts, labels = linked(docs, text, **settings)
    named = texts.join(labels, "node", "left").select(F.col("k").alias("nk"), F.coalesce("label", "node").alias("label"))
    rows = docs.select(F.col(f"`{key}`").alias("id"), text_key(F.col(f"`{text}`")).alias("k"))
    rows = rows.join(named, F.col("k") == F.col("nk"), "left").select("id", "label")
    rows = stored(rows, "labelled")
    sizes = rows.where("label is not null").groupBy(F.col("label").alias("l")).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_docs"))
    return rows.join(sizes, F.col("label") == F.col("l"), "left").select(
        F.col("id").alias(key),
        F.when(F.col("l").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_docs", F.lit(1).cast("long")).alias("class_docs"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row per class (the smallest key, then the smallest text key), columns unchanged."""
    texts, labels = linked(docs, text, **settings)
    named = texts.join(labels, "node", "left").select(F.col("k").alias("nk"), F.coalesce("label", "node").alias("label"))
    ids = docs.select(F.col(f"`{key}`").alias("id"), text_key(F.col(f"`{text}`")).alias("k"))
    counted = ids.groupBy("id", "k").agg(F.count(F.lit(1)).alias("rows")).join(named, F.col("k") == F.col("nk"))
    counted = stored(counted.select("id", "k", "label", "rows"), "class-rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k")
    best = counted.groupBy(F.col("label").alias("l")).agg(F.min(order).alias("best"))
    judged = counted.join(best, F.col("label") == F.col("l")).select(
        "id", "k", "rows", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("k") == F.col("best.k"))).alias("kept")
    )
    judged = stored(judged, "class-kept")
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(packed, F.col(f"`{key}`").alias("__i"), text_key(F.col(f"`{text}`")).alias("__k"))

    def side(df: DataFrame) -> DataFrame:
        return broadcast_if_small(df.select("id", "k"), 60)

    on = F.col("__i").eqNullSafe(F.col("id")) & (F.col("__k") == F.col("k"))
    # repeated rows of the one that stays are rare: only they are looked at again
    twice = judged.where("kept and rows > 1")
    gone = judged.where("not kept or rows > 1")
    single = rows.join(side(gone), on, "left_anti").select("__row")
    again = rows.join(side(twice), on, "left_semi").dropDuplicates(["__i", "__k"]).select("__row")
    return single.union(again).select("__row.*")
