"""Small helpers of the corpus operators: words, text keys, stored tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stored  # noqa: F401  the operators here take it from this module

#: Fixed separators of the word rule: blank and the ASCII controls tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BROADCAST_BYTES = 32 << 20


def words(text: Column, separators: str = BLANKS) -> Column:
    """Words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """128-bit key of a text; null has the key of the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where a lambda uses it repeatedly."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(w: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words; a shorter text with words is one run."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        return (
            F.when(
                F.size(w) >= size,
                F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])),
            )
            .when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(w, runs)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a stored table of narrow rows if its counted rows fit ``limit`` bytes.

    Larger tables stay with the shuffle join, whose skewed partitions adaptive execution splits.
    """
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound the Arrow batches that tasks hand to Python in bytes, so very long texts do not pile up."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(most + 1))) > most:
        spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system it belongs to, as all executors need it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def file_system(uri: str):
    """(pyarrow file system, path) of a qualified uri; runs inside tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
