"""URL rules by hashed expressions.

A URL is expanded into host suffixes (the host and all its parent domains) times path prefixes (of
each length that a rule's path has). Expressions meet the rules by an equality join on the first
``PREFIX`` hex digits of their SHA-256; the full digest confirms a match, and the longest rule wins
(then the longer host, then block before allow). Distinct (host, path) pairs are judged once.

Edge cases: a null url or one without ``://`` has an empty host and path; without a fitting rule
``rule`` is null and the verdict is ``default``; repeated pages each get their row; rules that are
repeated or contradict each other resolve by the order above; empty tables are fine; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import broadcast_if_small, let, lower_ascii, stored

PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """(e_host, e_path) of every host suffix and every path prefix of a listed length."""
    suffixes = let(
        F.split(host, r"\.", -1),
        lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")),
    )
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pairs = F.transform(
        suffixes, lambda s: F.transform(sizes, lambda n: F.struct(s.alias("e_host"), path.substr(F.lit(1), n).alias("e_path")))
    )
    return F.flatten(pairs)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, the winning rule and the verdict.

    ``rules`` has (host, path, action); a rule fits its host and all subdomains where the url's
    path starts with the rule's path.
    """
    host, path = host_and_path(F.col("__u"))
    rows = pages.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{url}`").alias("__u")).select(
        "__id", host.alias("host"), path.alias("path")
    )
    text = F.concat("host", "path")
    known = stored(
        rules.select("host", "path", "action", F.sha2(text, 256).alias("digest"), F.length(text).alias("size")).distinct(),
        "url-rules",
    ).withColumn("short", F.substring("digest", 1, PREFIX))
    lengths = sorted(r[0] for r in known.select(F.length("path")).distinct().collect())  # at most a path's length
    if not lengths:
        none = F.lit(None).cast("string")
        return rows.select(F.col("__id").alias(key), "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    known = known.select(
        "short", F.col("digest").alias("r_digest"), F.col("host").alias("r_host"), F.col("path").alias("r_path"), "action", "size"
    )
    # one rule's row holds two digests and its texts
    known = broadcast_if_small(known, 1000)
    distinct = rows.select("host", "path").distinct()
    expanded = distinct.select(
        "host", "path", F.explode(_expressions(F.col("host"), F.col("path"), lengths)).alias("e")
    ).select("host", "path", F.sha2(F.concat("e.e_host", "e.e_path"), 256).alias("digest"), F.col("e.e_host").alias("e_host"))
    fits = expanded.withColumn("short", F.substring("digest", 1, PREFIX)).join(known, "short")
    fits = fits.where((F.col("digest") == F.col("r_digest")) & (F.col("e_host") == F.col("r_host")))
    order = F.struct("size", F.length("r_host"), F.col("action"), F.concat("r_host", "r_path").alias("rule"))
    best = fits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.max(order).alias("b"))
    on = (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path"))
    return rows.join(best, on, "left").select(
        F.col("__id").alias(key),
        "host",
        "path",
        F.col("b.rule").alias("rule"),
        F.coalesce("b.action", F.lit(default)).alias("verdict"),
    )
