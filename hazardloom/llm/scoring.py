"""Language-model scores from a log-frequency Bloom filter.

All one- and two-word counts of the training documents are gathered exactly. A count is quantised as
``1 + floor(log_BASE(count))`` and the filter gets that many entries (n-gram, 1), (n-gram, 2), ...;
a probe asks for 1, 2, ... until one is missing, which gives the level back. The filter is blocked (the bits of an
entry lie in one 64-byte block, the entries of an n-gram in different ones) and is sized by entries, so that its share of
false hits is the same at every size.

The filter is cut into parts by the n-grams' hashes, as many as the tokens need, so every n-gram is in it and no task
holds more than its part. Texts are kept as chunks of word numbers. A chunk sends its different n-grams with their counts
to the parts; a part adds the counts up, builds its piece of the filter, asks it for every n-gram sent, and answers each
chunk with the levels (and, for the base score, the words' exact counts) in the order they were sent in. With the answers
a chunk scores its texts: a word after another has probability (c2 + MU * p1) / (c1 + MU), p1 being its smoothed share of
all tokens, with lower counts in the numerator and upper counts in the denominator, so it never passes 1.

``counts`` and ``build_filter`` make one filter in one piece, to be kept or sent along. It has a fixed largest size: where
the entries need more, n-grams below a count cutoff stay out, the cutoff coming from the exact count histogram.

Edge cases: null and empty texts consist of the end token; a null key is in the training part; an empty
training part gives N = V = 0 and finite scores; repeated rows each get a row; extra columns are ignored;
texts of any length are scored whole, each in one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import lists, mix, pieces
from .shared import lower_ascii, small_batches, stored, words

BASE, MU, BITS_PER_ENTRY, HASHES, BLOCK_BITS = 1.5, 4.0, 24, 4, 512
FILTER_BYTES, HEAD_WORDS, SEGMENT_BLOCKS = 64 << 20, 1_000_000, 1 << 14
#: No part of the filter is planned smaller.
LEAST_BYTES = 4096
CHUNK = 1_000_000

_PAIR = np.uint64(1 << 40)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word, mix(before, _PAIR))


def levels_of(count: np.ndarray, least: int) -> np.ndarray:
    """Quantised counts, 1 for ``least``."""
    return 1 + np.floor(np.log(count / least) / math.log(BASE) + 1e-9).astype(np.int64)


def count_bounds(level: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest count of a level; 0 for level 0."""
    low = np.ceil(least * BASE ** (level - 1) - 1e-6)
    high = np.maximum(np.ceil(least * BASE**level - 1e-6) - 1, low)
    return np.where(level > 0, low, 0.0), np.where(level > 0, high, 0.0)


def _entry(keys: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the entries (key, level): the high bits choose the block, the low ones the bits in it."""
    return mix(keys, np.full(1, 1_000_003 + level, np.uint64))


def entries(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hashes of all entries of the keys."""
    found = [_entry(keys[levels >= level], level) for level in range(1, int(levels.max(initial=0)) + 1)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def block_of(entry: np.ndarray, blocks: int) -> np.ndarray:
    return ((entry >> np.uint64(9 * HASHES)) % np.uint64(blocks)).astype(np.int64)


def _bits(entry: np.ndarray) -> Iterator[np.ndarray]:
    """Places of an entry's bits inside its block."""
    for j in range(HASHES):
        yield ((entry >> np.uint64(9 * j)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def segment_bytes(entry: np.ndarray, blocks: int, segment: int) -> bytes:
    """Bits of one segment of the filter."""
    start = (block_of(entry, blocks) - segment * SEGMENT_BLOCKS) * BLOCK_BITS
    on = np.zeros(min(SEGMENT_BLOCKS, blocks - segment * SEGMENT_BLOCKS) * BLOCK_BITS, bool)
    for bit in _bits(entry):
        on[start + bit] = True
    return np.packbits(on, bitorder="little").tobytes()


def filter_bytes(entry: np.ndarray, blocks: int) -> bytes:
    """Bits of a whole filter."""
    segment = block_of(entry, blocks) // SEGMENT_BLOCKS
    return b"".join(segment_bytes(entry[segment == s], blocks, s) for s in range(-(-blocks // SEGMENT_BLOCKS)))


def probe(bits: np.ndarray, keys: np.ndarray, blocks: int) -> np.ndarray:
    """Levels of the keys: entries (key, 1), (key, 2), ... are asked for until one is missing."""
    found = np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))
    level = 1
    while len(left):
        asked = _entry(keys[left], level)
        start = block_of(asked, blocks) * BLOCK_BITS
        alive = np.ones(len(left), bool)
        for bit in _bits(asked):
            at = start + bit
            alive &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        left = left[alive]
        found[left] = level
        level += 1
    return found


# ---- Spark --------------------------------------------------------------------------------------


def is_training(key: Column, folds: int = 7, held_out: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0)) != held_out


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words, then of the end token (no word holds a line feed)."""
    end = F.array(F.xxhash64(F.lit("\n")))
    return F.concat(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)), end)


def _previous(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each one; the end token before a first one."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    first = offsets[:-1]
    before[first] = values[offsets[1:] - 1]
    return before


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(n, h, c): exact counts of one-word and two-word n-grams in the training documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for n in (1, 2):
                found, c = np.unique(np.concatenate([x[n - 1] for x in held]), return_counts=True)
                for a in range(0, len(found), 200_000):
                    part = found[a : a + 200_000]
                    yield pa.record_batch(
                        [pa.array(np.full(len(part), n, np.int32)), pa.array(part.view(np.int64)),
                         pa.array(c[a : a + 200_000].astype(np.int64))], names=["n", "h", "c"]
                    )

        for batch in batches:
            values, offsets = lists(batch, 0)
            held.append((values.copy(), pair_keys(_previous(values, offsets), values)))
            size += len(values)
            if size >= 4 * CHUNK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    small_batches(docs.sparkSession)
    tokens = docs.where(is_training(F.col(f"`{key}`"))).select(token_hashes(F.col(f"`{text}`")).alias("t"))
    # the tasks have combined their n-grams already, so a second map-side pass would be wasted
    counted = tokens.mapInArrow(task, "n int, h long, c long").repartition("n", "h").groupBy("n", "h").agg(F.sum("c").alias("c"))
    return stored(counted, "ngram-counts")


def _cutoff(histogram: list, room: int) -> int:
    """The smallest count so that the sizes from it on add up to at most ``room``."""
    total, least = 0, 1 << 62
    for row in sorted(histogram, key=lambda r: -r["q"]):
        total += row["size"]
        if total > room:
            break
        least = row["least"]
    return least


def build_filter(grams: DataFrame, max_bytes: int = FILTER_BYTES) -> tuple[bytes, int, dict[int, int]]:
    """(bits, blocks, least count by n) of the filter over counted n-grams; at most ``max_bytes``.

    The least count is 1 if no n-gram stays out.
    """
    # at most 64 * 4 buckets of counts and two n; an n-gram has an entry per level
    hist = grams.groupBy("n", F.floor(F.log2("c") * 4).alias("q")).agg(F.sum(_level(F.col("c"))).alias("size"), F.min("c").alias("least")).collect()
    room = max_bytes * 8 // BITS_PER_ENTRY
    ones = [r for r in hist if r["n"] == 1]
    twos = [r for r in hist if r["n"] == 2]
    least = {1: _cutoff(ones, room // 2)}
    used = sum(r["size"] for r in ones if r["least"] >= least[1])
    least[2] = _cutoff(twos, room - used)
    used += sum(r["size"] for r in twos if r["least"] >= least[2])
    least = {n: m if any(r["least"] < m for r in of) else 1 for (n, m), of in zip(least.items(), (ones, twos))}
    blocks = max(1, -(-used * BITS_PER_ENTRY // BLOCK_BITS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            entry = entries(keys, levels_of(batch.column(1).to_numpy(), 1))  # whatever the cutoff
            segment = block_of(entry, blocks) // SEGMENT_BLOCKS
            yield pa.record_batch([pa.array(segment), pa.array(entry.view(np.int64))], names=["segment", "e"])

    def build(key, pdf):
        import pandas as pd

        entry = pdf["e"].to_numpy().view(np.uint64)
        return pd.DataFrame({"segment": [int(key[0])], "bits": [segment_bytes(entry, blocks, int(key[0]))]})

    kept = grams.where(F.col("c") >= F.when(F.col("n") == 1, least[1]).otherwise(least[2])).select("h", "c")
    parts = kept.mapInArrow(spread, "segment long, e long")
    made = stored(parts.groupBy("segment").applyInPandas(build, "segment long, bits binary"), "filter-segments")
    whole = bytearray(blocks * BLOCK_BITS // 8)
    for row in made.toLocalIterator():  # segments of 1 MB, max_bytes together
        at = row["segment"] * SEGMENT_BLOCKS * BLOCK_BITS // 8
        whole[at : at + len(row["bits"])] = row["bits"]
    return bytes(whole), blocks, least


def _level(count: Column) -> Column:
    """``levels_of`` counts from 1 on; 0 for null."""
    return F.coalesce(1 + F.floor(F.log(count.cast("double")) / math.log(BASE) + 1e-9), F.lit(0)).cast("int")


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The slices of ``values`` between the bounds, as binary values."""
    ends = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(found: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(found), kind)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte by byte: the high bytes of word numbers are few."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)


def unpack_numbers(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * size, "zstd", asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts in chunks of about CHUNK tokens: keys, held_out and lengths by text, the sorted different word hashes, word numbers."""
    small_batches(docs.sparkSession)
    k = F.col(f"`{key}`")
    rows = docs.select(token_hashes(F.col(f"`{text}`")).alias("t"), k.alias("id"), (~is_training(k)).alias("held_out"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, 0, CHUNK):
                values, offsets = lists(piece, 0)
                different, at = np.unique(values, return_inverse=True)
                lengths = np.diff(offsets)
                learned = int(lengths[~piece.column(2).to_numpy(zero_copy_only=False)].sum())
                whole = pa.array([0, piece.num_rows], pa.int32())
                yield pa.record_batch(
                    [pa.array([chunk]), pa.array([learned]), pa.ListArray.from_arrays(whole, piece.column(1)),
                     pa.ListArray.from_arrays(whole, piece.column(2)), pa.ListArray.from_arrays(whole, pa.array(lengths)),
                     pa.array([different.tobytes()]), pa.array([pack_numbers(at)])],
                    names=["chunk", "learned", "ids", "held_out", "lengths", "words", "numbers"],
                )
                chunk += 1

    kind = rows.schema["id"].dataType.simpleString()
    made = f"chunk long, learned long, ids array<{kind}>, held_out array<boolean>, lengths array<long>, words binary, numbers binary"
    return stored(rows.mapInArrow(task, made), "token-chunks")


class _Chunk:
    """Tokens of a chunk: ``at`` numbers their words, ``pair_at`` the pairs they end, both by sorted hash."""

    def __init__(self, words: bytes, numbers: bytes, lengths: np.ndarray):
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.words = np.frombuffer(words, np.uint64)
        self.at = unpack_numbers(numbers, int(self.offsets[-1]))
        self.history = _previous(self.at, self.offsets)
        self.pairs, self.pair_at = np.unique(pair_keys(self.words[self.history], self.words[self.at]), return_inverse=True)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; sorted hashes have sorted parts."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _sent(made: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, words, their counts, pairs, their counts): what each chunk sends to each part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                chunk = _Chunk(row["words"], row["numbers"], lengths)
                learned = np.repeat(~np.array(row["held_out"], bool), lengths)
                columns, some = [], np.zeros(parts, bool)
                for keys, at in ((chunk.words, chunk.at), (chunk.pairs, chunk.pair_at)):
                    bounds = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1))
                    count = np.bincount(at[learned], minlength=len(keys)).astype(np.uint32)
                    columns += [_binaries(keys, bounds), _binaries(count, bounds)]
                    some |= np.diff(bounds) > 0
                sent = pa.record_batch(
                    [pa.array(np.arange(parts)), pa.array(np.full(parts, row["chunk"])), *columns],
                    names=["part", "chunk", "words", "word_counts", "pairs", "pair_counts"],
                )
                yield sent.filter(pa.array(some))

    asked = made.select("chunk", "held_out", "lengths", "words", "numbers")
    return asked.mapInArrow(task, "part long, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary")


def answers(made: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, vocabulary, counts, levels, pair_levels): the parts' answers, in the order of the chunks' sorted hashes.

    ``vocabulary`` has a part's number of learned words in one of its rows and 0 in the others.
    """
    entry_bits = BITS_PER_ENTRY

    def part(table: pa.Table) -> pa.Table:
        different, at, counts, bounds = [], [], [], []
        for name in ("word", "pair"):
            sent = table.column(f"{name}s").to_pylist()
            keys, where = np.unique(_joined(sent, np.uint64), return_inverse=True)
            count = np.bincount(where, _joined(table.column(f"{name}_counts").to_pylist(), np.uint32), len(keys)).astype(np.int64)
            different.append(keys)
            at.append(where)
            counts.append(count)
            bounds.append(np.concatenate([[0], np.cumsum([len(x) // 8 for x in sent])]))
        keys, count = np.concatenate(different), np.concatenate(counts)
        entry = entries(keys, np.where(count > 0, levels_of(np.maximum(count, 1), 1), 0))
        blocks = max(1, -(-len(entry) * entry_bits // BLOCK_BITS))
        level = probe(np.frombuffer(filter_bytes(entry, blocks), np.uint8), keys, blocks).astype(np.uint8)
        of_words, of_pairs = level[: len(different[0])], level[len(different[0]) :]
        vocabulary = np.zeros(table.num_rows, np.int64)
        vocabulary[0] = np.count_nonzero(counts[0])
        return pa.table(
            [table.column("chunk"), table.column("part"), pa.array(vocabulary), _binaries(counts[0][at[0]], bounds[0]),
             _binaries(of_words[at[0]], bounds[0]), _binaries(of_pairs[at[1]], bounds[1])],
            names=["chunk", "part", "vocabulary", "counts", "levels", "pair_levels"],
        )

    answered = _sent(made, parts).groupBy("part").applyInArrow(
        part, "chunk long, part long, vocabulary long, counts binary, levels binary, pair_levels binary"
    )
    return stored(answered, "ngram-levels")


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = FILTER_BYTES, head_words: int = HEAD_WORDS
) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score and the model's score.

    A part has about ``head_words`` of all tokens, and its piece of the filter ``max_bytes`` (but no fewer than LEAST_BYTES).
    """
    made = chunks(docs, key, text)
    total, tokens = made.agg(
        F.coalesce(F.sum("learned"), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    ).first()
    # an n-gram has no more entries than occurrences, and there are two n-grams to a token
    parts = max(1, -(-tokens // head_words), -(-2 * total * BITS_PER_ENTRY // (8 * max(max_bytes, LEAST_BYTES))))
    answered = answers(made, parts)
    vocabulary = answered.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0]
    denominator = float(total + vocabulary + 1)

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        row = texts.select(["words", "numbers", "lengths"]).to_pylist()[0]
        lengths = np.array(row["lengths"], np.int64)
        chunk = _Chunk(row["words"], row["numbers"], lengths)
        found = found.sort_by("part")
        count, level1, level2 = (
            _joined(found.column(name).to_pylist(), kind)
            for name, kind in (("counts", np.int64), ("levels", np.uint8), ("pair_levels", np.uint8))
        )
        sums = lambda x: np.add.reduceat(x, chunk.offsets[:-1])
        base = np.log10(count + 1) - math.log10(denominator)
        low1, high1 = count_bounds(level1.astype(np.int64), 1)
        low2 = count_bounds(np.arange(256), 1)[0][level2][chunk.pair_at]
        share = (low1 + 1) / denominator
        model = np.log10(low2 + MU * share[chunk.at]) - np.log10(np.maximum(high1[chunk.history], low2) + MU)
        ids, held_out = (texts.column(name).combine_chunks().flatten() for name in ("ids", "held_out"))
        return pa.table(
            [ids, held_out, pa.array(lengths), pa.array(sums((count > 0).astype(np.int64)[chunk.at])),
             pa.array(np.full(len(lengths), total)), pa.array(sums(base[chunk.at])), pa.array(sums(model))],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = made.schema["ids"].dataType.elementType.simpleString()
    scored = made.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumnRenamed("id", key)
