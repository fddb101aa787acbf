"""Quality rules: per-text counts and cross-document line frequency.

A line is normalised (words joined by one blank, lower case) and hashed. For each host the
distinct documents that hold the line are counted; exact copies of one text count as one document,
so copies alone never turn a text into boilerplate. Lines of any length that more than ``max_docs``
documents of a host share are removed, and a document that keeps less than ``min_left`` of its words is
rejected. ``keep_good`` counts near copies as one document, too: texts whose runs of five words agree by
``SIMILARITY`` (found by bands of smallest hashes, verified on all runs). ``judge`` counts distinct texts, as
its SQL does.

Edge cases: a null text is an empty text, it has no words and fails the base rule; null hosts form
one host; rows with the same id or the same text each get their own result row; an empty table
gives an empty result; extra columns are ignored (``keep_good`` returns them unchanged).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .shared import HAS_WORD, broadcast_if_small, let, shingle_hashes, stored, text_key, words

MAX_DOCS, MIN_LEFT = 10, 0.3
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 10, 3


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _window_hashes(w: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(h: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order."""
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def hits(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        at = F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"]))
        at = F.filter(at, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, hits))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HAS_WORD))


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and ``base_failed`` (replacing columns of these names).

    Words, lines and window hashes are columns of their own, each used more than once, so they are
    computed once per row.
    """
    t = _text(text)
    df = df.withColumns({"__w": words(t), "__l": _lines(t)}).withColumn("__h3", _window_hashes(F.col("__w")))
    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": symbols,
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": _repeated_words(F.col("__h3")),
    }
    df = df.withColumns({name: c.cast("long") for name, c in counts.items()})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__w", "__l", "__h3")


def _hashed_lines(text: str) -> Column:
    """(hash, words) of all lines with words."""

    def hashed(w: Column) -> Column:
        line = F.unhex(F.md5(F.lower(F.array_join(w, " ")).cast("binary")))
        return F.struct(line.alias("line"), F.size(w).cast("long").alias("n"))

    return F.transform(_lines(_text(text)), lambda x: let(words(x), hashed))


def near_copies(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """(ck, class) of the texts among ``keys`` (k) that are near copies of a text with a smaller key.

    A text meets the smallest key of each of its bands only, so a large group is not paired with itself.
    """

    def runs(some: DataFrame) -> DataFrame:
        found = docs.select(text_key(F.col(f"`{text}`")).alias("k"), F.col(f"`{text}`").alias("t"))
        found = found.join(broadcast_if_small(some, 60), "k", "left_semi")
        return found.select("k", F.array_distinct(shingle_hashes(words(F.col("t")), SHINGLE)).alias("s"))

    x = F.col("x")
    row = F.pmod(F.shiftrightunsigned(x, 8), F.lit(ROWS))
    least = [F.min(F.when(row == j, x)).alias(f"m{j}") for j in range(ROWS)]
    bands = runs(keys).select("k", F.explode("s").alias("x")).groupBy("k", F.pmod(x, F.lit(BANDS)).alias("band")).agg(*least)
    bands = stored(bands.select("k", F.xxhash64("band", *[F.coalesce(f"m{j}", F.lit(0)) for j in range(ROWS)]).alias("b")), "line-bands")
    first = bands.groupBy("b").agg(F.min("k").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = stored(bands.join(first, "b").where("k <> lead").select("k", "lead").distinct(), "line-pairs")
    met = stored(pairs.select("k").union(pairs.select("lead")).distinct(), "line-met")
    sets = stored(runs(met).groupBy("k").agg(F.first("s").alias("s")), "line-runs")
    both = pairs.join(sets, "k").join(sets.select(F.col("k").alias("lead"), F.col("s").alias("ls")), "lead")
    common = F.size(F.array_intersect("s", "ls"))
    near = both.where(common >= SIMILARITY * (F.size("s") + F.size("ls") - common))
    found = stored(near.groupBy("k").agg(F.min("lead").alias("class")), "line-classes")
    # a class may itself have a smaller one; each round halves what is left of a chain
    while True:
        up = found.select(F.col("k").alias("uk"), F.col("class").alias("up"))
        further = found.join(up, F.col("class") == F.col("uk"), "left")
        if not further.where("up is not null").limit(1).count():
            return found.withColumnRenamed("k", "ck")
        found = stored(further.select("k", F.coalesce("up", "class").alias("class")), "line-classes")


def removed_words(
    texts: DataFrame, max_docs: int = MAX_DOCS, near: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``gone`` of ``total`` words per (host ``h``, text key ``k``) that loses any to line frequency.

    ``texts`` has (h, k, n_words, lines). A row without a line in every document carries its words and
    counts the copies of (host, text). ``near`` gives the classes of near copies among text keys.
    """
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(F.lit(None).cast("binary").alias("line"), F.col("n_words").alias("n"), F.lit(1).cast("long").alias("copies")))
    own_lines = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), zero.alias("copies")))
    lines = texts.select("h", "k", F.inline(F.concat(whole, own_lines)))
    counted = lines.groupBy("h", "line", "k").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    counted = stored(counted, "lines")
    frequent = (
        counted.where(F.col("line").isNotNull())
        .groupBy("h", "line")
        .agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") > max_docs)
        .select(F.col("h").alias("fh"), F.col("line").alias("fl"))
    )
    frequent = broadcast_if_small(stored(frequent, "frequent-lines"), 200)
    same = F.col("h").eqNullSafe(F.col("fh")) & (F.col("line") == F.col("fl"))
    held = counted.join(frequent, same, "left_semi")
    if near is not None:
        # classes only lower a line's count, so only lines that are frequent by texts are counted again
        held = stored(held, "held-lines")
        classes = near(stored(held.select("k").distinct(), "held-keys"))
        again = held.join(broadcast_if_small(classes, 80), F.col("k") == F.col("ck"), "left")
        again = again.groupBy("h", "line").agg(F.count_distinct(F.coalesce("class", "k")).alias("docs")).where(F.col("docs") > max_docs)
        again = again.select(F.col("h").alias("fh"), F.col("line").alias("fl"))
        held = held.join(broadcast_if_small(stored(again, "frequent-lines"), 200), same, "left_semi")
    lost = held.union(counted.where(F.col("line").isNull()))
    own = F.col("line").isNull()
    return (
        lost.groupBy("h", "k")
        .agg(
            F.sum(F.when(~own, F.col("n"))).alias("gone"),
            F.sum(F.when(own, F.col("n"))).alias("total"),
            F.sum("copies").alias("copies"),
        )
        .where("gone is not null")
        .select("h", "k", F.expr("gone div copies").alias("gone"), F.expr("total div copies").alias("total"))
    )


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_left: float = MIN_LEFT,
    max_docs: int = MAX_DOCS,
) -> DataFrame:
    """Per row of ``docs``: ``key``, the base counts, ``words_left`` and ``kept``."""
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{host}`").alias("__h"), F.col(f"`{text}`").alias("__t"))
    rows = rows.withColumns({"__k": text_key(F.col("__t")), "lines": _hashed_lines("__t")})
    base = stored(with_base(rows, "__t").drop("__t"), "base-counts")
    removed = removed_words(base.select(F.col("__h").alias("h"), F.col("__k").alias("k"), "n_words", "lines"), max_docs)
    on = F.col("__h").eqNullSafe(F.col("h")) & (F.col("__k") == F.col("k"))
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    return (
        base.drop("lines")
        .join(removed, on, "left")
        .withColumn("words_left", left)
        .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= min_left * F.col("n_words")))
        .drop("__h", "__k", "h", "k", "gone", "total")
        .withColumnRenamed("__id", key)
    )


def keep_good(
    docs: DataFrame, text: str = "text", host: str = "source", min_left: float = MIN_LEFT, max_docs: int = MAX_DOCS,
) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged.

    The texts stay where they are: only the few depleted (host, text) keys travel.
    """
    h, t = F.col(f"`{host}`"), F.col(f"`{text}`")
    texts = docs.select(
        h.alias("h"), text_key(t).alias("k"), F.size(words(t)).cast("long").alias("n_words"),
        _hashed_lines(text).alias("lines"),
    )
    lost = removed_words(texts, max_docs, lambda keys: near_copies(docs, keys, text)).where(F.col("total") - F.col("gone") < min_left * F.col("total"))
    lost = broadcast_if_small(stored(lost.select("h", "k"), "depleted"), 200)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = with_base(docs.select(packed, h.alias("__h"), t.alias("__t")), "__t")
    # a generator instead of a filter: a filter would be evaluated below the word columns, with
    # the words split anew for each use
    good = rows.select("__row", "__h", text_key(F.col("__t")).alias("__k"), F.explode(F.when(~F.col("base_failed"), F.array(F.lit(1)))))
    on = F.col("__h").eqNullSafe(F.col("h")) & (F.col("__k") == F.col("k"))
    return good.join(lost, on, "left_anti").select("__row.*")
