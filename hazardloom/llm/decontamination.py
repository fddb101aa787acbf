"""Benchmark decontamination by a prefix-filtered join of word shingles.

Every item is cut into windows of ``WINDOW`` words (a shorter item is one window) and each window
into shingles of ``SHINGLE`` words. A document can hold a window only where it holds all of the
window's shingles, so the join needs just the shortest necessary prefix: the one shingle that is
rarest in the documents. Length and positional bounds discard windows that would stick out of the
text, and a window counts only if each of its shingles stands at its place, which is the exact run
of words. Documents are grouped by text, so copies are verified once.

Edge cases: null and empty texts have no words and are clean; null or empty items have no window;
repeated items and items with the same id count once, an item without an id marks words but is not
listed; repeated documents each get their row; empty tables on either side give no hits; extra
columns are ignored (``drop_contaminated`` returns them unchanged).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .shared import broadcast_if_small, lower_ascii, stored, text_key, words

WINDOW, SHINGLE = 13, 5
#: Fixed complement of the word characters, after lower-casing A-Z.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
NON_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return words(lower_ascii(text), NON_WORD)


def _run_hashes(w: Column, size: int) -> Column:
    """Hashes of the runs of exactly ``size`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(w) - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
    return F.when(F.size(w) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def _places(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, n, hash, pos) of all runs of the given sizes; ``rows`` has (key, w)."""
    n = F.size("w")
    found = rows.select("key", n.alias("n"), F.posexplode(F.concat(*[_run_hashes(F.col("w"), k) for k in sizes])).alias("at", "hash"))
    # the runs of one size follow those of the sizes before
    pos, before = F.col("at"), F.lit(0)
    for k in sizes[:-1]:
        before = before + F.greatest(F.lit(0), F.col("n") - k + 1)
        pos = F.when(F.col("at") >= before, F.col("at") - before).otherwise(pos)
    return found.select("key", "n", "hash", pos.cast("int").alias("pos"))


def _windows(items: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Stored: (window, len, pos, hash) of the distinct windows' shingles; (window, item) members;
    the shingle sizes that occur."""
    w = F.col("w")
    cut = F.expr(f"transform(sequence(1, size(w) - least(size(w), {WINDOW}) + 1), s -> slice(w, s, {WINDOW}))")
    runs = (
        items.select(F.col(f"`{item}`").cast("string").alias("item"), tokens(F.col(f"`{text}`")).alias("w"))
        .where(F.size(w) > 0)
        .select("item", F.explode(cut).alias("w"))
        .withColumn("window", F.unhex(F.md5(F.concat_ws(" ", "w"))))
    )
    members = stored(runs.select("window", "item").distinct(), "window-items")
    whole = runs.groupBy("window").agg(F.first("w").alias("w"))
    by_size = [
        whole.where(F.size("w") >= SHINGLE if k == SHINGLE else F.size("w") == k).select(
            "window", F.size("w").alias("len"), F.lit(k).alias("k"), F.posexplode(_run_hashes(w, k)).alias("pos", "hash")
        )
        for k in range(1, SHINGLE + 1)
    ]
    shingles = stored(reduce(DataFrame.unionByName, by_size), "window-shingles")
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())  # at most SHINGLE numbers
    return shingles.drop("k"), members, sizes


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"):
    """(verified, members): ``verified`` has (key, start, len, window) for each window found in a text."""
    shingles, members, sizes = _windows(items, item, item_text)
    wanted = broadcast_if_small(shingles.select("hash").distinct(), 24)
    texts = docs.select(text_key(F.col(f"`{text}`")).alias("key"), tokens(F.col(f"`{text}`")).alias("w"))
    found = _places(texts, sizes or [SHINGLE])
    found = stored(found.join(wanted, "hash", "left_semi").distinct(), "found-shingles")
    rarity = found.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"))
    prefix = (
        shingles.join(rarity, "hash", "left")
        .withColumn("docs", F.coalesce("docs", F.lit(0)))
        .groupBy("window", "len")
        .agg(F.min(F.struct("docs", "hash", "pos")).alias("p"), F.count(F.lit(1)).alias("need"))
        .where("p.docs > 0")
        .select("window", "len", "need", F.col("p.hash").alias("hash"), F.col("p.pos").alias("at"))
    )
    prefix = broadcast_if_small(stored(prefix, "window-prefixes"), 80)
    start = F.col("pos") - F.col("at")
    candidates = (
        found.join(prefix, "hash")
        .where((start >= 0) & (start + F.col("len") <= F.col("n")))
        .select("key", start.alias("start"), "window", "len", "need")
        .distinct()
    )
    parts = broadcast_if_small(shingles.select("window", F.col("pos").alias("off"), "hash"), 60)
    asked = candidates.join(parts, "window").withColumn("pos", F.col("start") + F.col("off"))
    verified = (
        asked.join(found, ["key", "pos", "hash"], "left_semi")
        .groupBy("key", "start", "window", "len", "need")
        .agg(F.count(F.lit(1)).alias("got"))
        .where("got = need")
        .select("key", "start", "len", "window")
    )
    return stored(verified, "found-windows"), members


def _covered(spans: Column) -> Column:
    """Positions inside (start, end) spans, each once."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["reach"], s["start"]))).alias("n"),
        F.greatest(a["reach"], s["end"]).alias("reach"),
    )
    return F.aggregate(F.sort_array(spans), first, step, lambda a: a["n"])


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per text key with a window: words hit, items found and their digest."""
    verified, members = occurrences(docs, items, text, item, item_text)
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("len")).cast("long").alias("end"))
    spans = verified.groupBy("key").agg(F.collect_set(span).alias("s")).select("key", _covered(F.col("s")).alias("n_hit"))
    listed = (
        verified.select("key", "window").distinct().join(broadcast_if_small(members, 60), "window")
        .select("key", "item").distinct()
        .groupBy("key")
        .agg(F.count("item").alias("n_items"), F.sort_array(F.collect_set("item")).alias("ids"))
        .select("key", "n_items", F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    )
    return spans.join(listed, "key")


def _word_count(text: Column) -> Column:
    return F.size(words(text, NON_WORD_ANY_CASE)).cast("long")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """One row per document: words, words hit, items found, and whether it is contaminated."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("__id"), _word_count(t).alias("n_words"), text_key(t).alias("__k"))
    found = hits(docs, items, text, **names).withColumnRenamed("key", "__f")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return rows.join(found, F.col("__k") == F.col("__f"), "left").select(
        F.col("__id").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """The clean rows of ``docs``, columns unchanged."""
    found = stored(hits(docs, items, text, **names).select("key", "n_hit"), "hit-texts")
    found = broadcast_if_small(found, 40)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(packed, F.col(f"`{text}`").alias("__t"))
    bad = (text_key(F.col("__t")) == F.col("key")) & (20 * F.col("n_hit") >= _word_count(F.col("__t")))
    return rows.join(found, bad, "left_anti").select("__row.*")
