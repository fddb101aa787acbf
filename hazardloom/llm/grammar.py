"""Token ids of whole texts in binary shards, compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by key; every task encodes its texts and writes shards of
about ``shard_tokens`` ids. Per shard the most frequent id pairs are replaced by nonterminals, round
after round (many pairs a round, left to right, never across a document's end), until no pair is
frequent or all symbols are in use. A shard holds its rules, their expansion lengths, the documents' symbol and id counts and
the symbols, so one document is decoded by reading only its own symbols.

Files are named per task attempt and listed in a manifest that Spark commits; files of a lost or
repeated attempt are in no manifest and are never read.

Edge cases: null texts are empty and hold only the end id; null keys sort first; rows with the same
key are ordered by text, and identical rows follow each other; an empty table gives an empty result;
extra columns are ignored; a text longer than a shard is one document of a larger shard.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path
from .shared import file_system, qualified, small_batches, stored

SHARD_TOKENS, MIN_COUNT, RULES_WIDE = 2_000_000, 16, 16_384
#: A round takes at most this part of the symbols, so that later rounds can build on earlier ones.
ROUND_PART = 5
_DECODED_AT_ONCE = 1 << 16
END_ID = 0
MAGIC = b"RPAIR1\0\0"
_HEAD = struct.Struct("<8sIIIIQ")

# ---- grammar ------------------------------------------------------------------------------------


def _pairs(seq: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Key of the pair at every place but the last, the largest key (of no pair) at documents' ends; number of these."""
    shift = 8 * seq.itemsize
    wide = np.uint32 if seq.itemsize == 2 else np.uint64
    keys = (seq[:-1].astype(wide) << wide(shift)) | seq[1:]
    across = np.unique(ends[ends < len(seq)]) - 1
    # the last symbol is made in the last round, so no pair has two of them
    keys[across] = np.iinfo(wide).max
    return keys, len(across)


def _frequent(order: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys found at least ``least`` times among sorted keys, ascending, and how often."""
    # the places that have their own key ``least - 1`` places further: as many to a key as its count exceeds that
    more = max(least, 1) - 1
    found = order[np.flatnonzero(order[: max(len(order) - more, 0)] == order[more:])]
    first = np.flatnonzero(np.concatenate([found[:1] == found[:1], found[1:] != found[:-1]]))
    return found[first], np.diff(np.append(first, len(found))) + more


def _slots(keys: np.ndarray) -> np.ndarray:
    if keys.itemsize == 4:
        return (keys * np.uint32(2654435769)) >> np.uint32(14)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def compress(
    ids: np.ndarray, lengths: np.ndarray, base: int, min_count: int = MIN_COUNT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of documents of ``lengths`` ids below ``base``: (symbols, symbols per document, rules).

    Rule j stands for symbol ``base + j``. Two-byte symbols are used where the ids leave room.
    """
    narrow = base + 1024 <= 1 << 16
    room = (1 << 16) - base if narrow else RULES_WIDE
    seq = ids.astype(np.uint16 if narrow else np.uint32)
    ends = np.cumsum(lengths)
    rules: list[np.ndarray] = []
    made = 0
    while made < room and len(seq) > 1:
        most = min(room - made, -(-room // ROUND_PART))
        keys, across = _pairs(seq, ends[lengths > 0])
        pairs, count = _frequent(np.sort(keys)[: len(keys) - across], min_count)
        if not len(pairs):
            break
        # exact top, ties by the smaller pair
        pairs = pairs[np.argsort(-count, kind="stable")[:most]]
        # one rule per slot of the lookup; a pair that meets a fuller slot waits for the next round
        _, kept = np.unique(_slots(pairs), return_index=True)
        pairs = pairs[np.sort(kept)]
        # an empty slot holds the first pair, which differs from every key that comes there
        table = np.full(1 << 18, pairs[0])
        table[_slots(pairs)] = pairs
        slots = _slots(keys)
        hit = np.flatnonzero(table[slots] == keys)
        # overlapping places: every second one of a run, from the left
        start = np.concatenate([[True], hit[1:] - hit[:-1] != 1])
        offset = hit - np.maximum.accumulate(hit * start)
        chosen = hit[offset & 1 == 0]
        rule = np.zeros(len(table), np.int32)
        rule[_slots(pairs)] = np.arange(len(pairs), dtype=np.int32)
        seq[chosen] = (base + made + rule[slots[chosen]]).astype(seq.dtype)
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        ends = ends - np.searchsorted(chosen, ends - 1)
        seq = seq[keep]
        shift = 8 * seq.itemsize
        left = (pairs >> pairs.dtype.type(shift)).astype(np.uint32)
        rules.append(np.stack([left, (pairs & pairs.dtype.type((1 << shift) - 1)).astype(np.uint32)], 1))
        made += len(pairs)
    symbol_counts = np.diff(np.concatenate([[0], ends])).astype(np.uint32)
    return seq, symbol_counts, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(len(rules), np.uint32)
    for j, (a, b) in enumerate(rules.tolist()):
        out[j] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def _expansions(rules: np.ndarray, base: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for pair in rules.tolist():
        parts = [out[s - base] if s >= base else np.array([s], np.uint32) for s in pair]
        out.append(np.concatenate(parts))
    return out


def decode(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int, flat: np.ndarray | None = None) -> np.ndarray:
    """The ids of a run of symbols."""
    if flat is None:
        flat = flat_expansions(rules, base)
    starts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    parts = [np.zeros(0, np.uint32)]
    # pieces whose intermediate arrays stay in the cache
    for a in range(0, len(symbols), _DECODED_AT_ONCE):
        s = symbols[a : a + _DECODED_AT_ONCE].astype(np.int64)
        at = np.flatnonzero(s >= base)
        j = s[at] - base
        length = np.ones(len(s), np.int64)
        length[at] = sizes[j]
        out = np.repeat(s, length)
        # where each rule's expansion begins in the output, and the places it fills
        size = length[at]
        filled = np.cumsum(size) - size
        inside = np.arange(int(size.sum()))
        begin = (np.cumsum(length) - length)[at]
        out[np.repeat(begin - filled, size) + inside] = flat[np.repeat(starts[j] - filled, size) + inside]
        parts.append(out.astype(np.uint32))
    return np.concatenate(parts)


def flat_expansions(rules: np.ndarray, base: int) -> np.ndarray:
    parts = _expansions(rules, base)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# ---- file format --------------------------------------------------------------------------------


def pack(ids: np.ndarray, lengths: np.ndarray, base: int) -> bytes:
    """A shard: head, rules, expansion lengths, symbols and ids per document, symbols (little endian)."""
    symbols, counts, rules = compress(ids, lengths, base)
    head = _HEAD.pack(MAGIC, base, symbols.itemsize, len(rules), len(lengths), len(symbols))
    little = lambda x, t: np.ascontiguousarray(x, dtype=t).tobytes()
    return b"".join(
        [head, little(rules, "<u4"), little(expansion_lengths(rules, base), "<u4"), little(counts, "<u4"),
         little(lengths, "<u4"), little(symbols, f"<u{symbols.itemsize}")]
    )


class Shard:
    """Random access to the documents of a shard."""

    def __init__(self, data: bytes):
        magic, self.base, width, n_rules, self.docs, n_symbols = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2)
        self.sizes = take(n_rules, "<u4")
        counts, self.lengths = take(self.docs, "<u4"), take(self.docs, "<u4")
        self.symbols = take(n_symbols, f"<u{width}")
        self.offsets = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        self._flat = flat_expansions(self.rules, self.base)

    def document(self, i: int) -> np.ndarray:
        return decode(self.symbols[self.offsets[i] : self.offsets[i + 1]], self.rules, self.sizes, self.base, self._flat)

    def all_ids(self) -> np.ndarray:
        return decode(self.symbols, self.rules, self.sizes, self.base, self._flat)


# ---- encoding -----------------------------------------------------------------------------------


class _Remembered(dict):
    """Ids of runs with the blank before them; a bounded number is kept, and none that holds a line feed."""

    def __init__(self, letters: Callable[[str], bytes], other: Callable[[str], bytes], most: int):
        self._letters, self._other, self._most = letters, other, most

    def __missing__(self, run: str) -> bytes:
        if run.isalpha() and run.isascii():
            found = self._letters(run)
        else:
            found = self._other(run)
        if len(self) < self._most and "\n" not in run:
            self[run] = found
        return found


class Encoder:
    """Ids of texts, equal to the tokenizer's own on the whole text.

    A single blank between two other characters always starts a new pre-token of a byte-level
    tokenizer with the usual split pattern, so the runs between such blanks are encoded on their own
    and remembered (a bounded number of them).
    """

    REMEMBER_RUNS, REMEMBER_WORDS = 1_400_000, 300_000
    #: White space other than blank and line feed.
    _rare = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _cut = re.compile(r"(?<=\S) (?=\S)")
    _letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    #: ASCII punctuation, without the apostrophe that begins pre-tokens such as 's.
    _marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._tokenize, self._id = self._t.model.tokenize, attrgetter("id")
        spec = json.loads(self._t.to_str())
        # texts that hold an added token's own text are left to the tokenizer
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or [] if x["content"]]
        self._added = re.compile("|".join(added)) if added else None
        pre = spec.get("pre_tokenizer") or {}
        self._by_run = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self._by_run = self._by_run and spec.get("normalizer") is None
        self.size = self._t.get_vocab_size()
        self._type, self._code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        # ids by text: with a blank before it, and without one
        self._runs: dict[str, bytes] = _Remembered(
            lambda run: self._model_ids(self._blank + run), self._run, self.REMEMBER_RUNS
        )
        self._words: dict[str, bytes] = {}
        # the byte alphabet of byte-level tokenizers: printable bytes stand for themselves
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in own]
        self._alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self._blank = chr(self._alphabet[32])
        self._feed = self._model_ids(chr(self._alphabet[10]))

    def _ids(self, text: str) -> bytes:
        return np.array(self._t.encode(text, add_special_tokens=False).ids, self._type).tobytes()

    def _model_ids(self, mapped: str) -> bytes:
        return array(self._code, list(map(self._id, self._tokenize(mapped)))).tobytes()

    def _word(self, word: str, blank: str) -> bytes:
        """A pre-token of letters or marks, straight through the model."""
        known, most = (self._runs, self.REMEMBER_RUNS) if blank else (self._words, self.REMEMBER_WORDS)
        found = known.get(word)
        if found is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self._alphabet)
            found = self._model_ids(self._blank + mapped if blank else mapped)
            if len(known) < most:
                known[word] = found
        return found

    def _line(self, line: str, blank: str) -> bytes | None:
        """Ids of letters and the marks after them; None for any other text."""
        letters = line.rstrip(self._marks)
        if not (letters.isascii() and letters.isalpha()) and not self._letters.fullmatch(letters):
            return None
        found = self._word(letters, blank)
        return found if len(letters) == len(line) else found + self._word(line[len(letters) :], "")

    def _run(self, run: str, blank: str = " ") -> bytes:
        """Ids of a run, with the blank before it."""
        if "\n" not in run:
            found = self._line(run, blank)
            return self._ids(blank + run) if found is None else found
        # a lone line feed between other characters is a pre-token of its own
        first, *rest = run.split("\n")
        parts = [self._line(first, blank), *[self._line(x, "") for x in rest]]
        return self._ids(blank + run) if None in parts else self._feed.join(parts)

    def _odd(self, text: str) -> bool:
        """Whether a blank of the text has white space or an end of the text next to it."""
        lines = text.split("\n")
        return (
            "  " in text or any(x[:1] == " " or x[-1:] == " " for x in lines)
            or (not "".join(lines).isprintable() and self._rare.search(text) is not None)
        )

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self._by_run or (self._added and self._added.search(text)):
            return np.frombuffer(self._ids(text), self._type)
        runs = self._cut.split(text) if self._odd(text) else text.split(" ")
        return np.frombuffer(self._run(runs[0], "") + b"".join(map(self._runs.__getitem__, runs[1:])), self._type)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process, so that later tasks find what earlier ones remembered."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- Spark --------------------------------------------------------------------------------------

_MANIFEST = "part int, shard int, path string, docs long, tokens long"


def write(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the shards; (manifest, keys): files in order, and the key of each document in a file."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder or scratch_path(spark, "token-shards"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), t.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(folder)
        encoder = encoder_of(tokenizer)
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list = []
        held = 0
        end = np.array([END_ID], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal ids, keys, held, shard
            lengths = np.array([len(x) for x in ids], np.int64)
            name = f"part-{part:06d}-{shard:06d}-{uuid.uuid4().hex[:12]}.rpair"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(np.concatenate(ids), lengths, encoder.size))
            found = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]),
                 pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([keys], pa.list_(pa.int64()))],
                names=["part", "shard", "path", "docs", "tokens", "ids"],
            )
            ids, keys, held, shard = [], [], 0, shard + 1
            return found

        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.concatenate([encoder.encode(s.as_py()), end])
                ids.append(found)
                keys.append(k)
                held += len(found)
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    listed = stored(rows.mapInArrow(task, f"{_MANIFEST}, ids array<long>"), "token-manifest")
    return listed.drop("ids"), listed.select("path", "ids")


def read(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Per document, from the files: key, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``, file and place."""
    spark = manifest.sparkSession
    upto = Window.unboundedPreceding
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(upto, -1)  # one row per task of the writer
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(upto, -1)
    placed = manifest.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("p"))
    placed = placed.select("path", (F.col("base") + F.col("inner")).cast("long").alias("start")).join(keys, "path")
    # a stated number of tasks: the rows are few and small, the files behind them are not
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = stored(placed, "token-files").repartition(tasks, "path")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, ids in zip(*(batch.column(i) for i in range(3))):
                fs, where = file_system(path.as_py())
                with fs.open_input_stream(where) as source:
                    shard = Shard(source.read())
                tokens = shard.all_ids().astype("<u4")
                ends = np.cumsum(shard.lengths.astype(np.int64))
                starts = ends - shard.lengths
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = shard.docs
                yield pa.record_batch(
                    [ids.values, pa.array(starts + start.as_py(), pa.int64()), pa.array(shard.lengths.astype(np.int64)),
                     pa.array(crc, pa.int64()), pa.array([path.as_py()] * n), pa.array(np.arange(n, dtype=np.int32))],
                    names=["id", "start", "n_tokens", "ids_crc32", "path", "place"],
                )

    return placed.mapInArrow(task, "id long, start long, n_tokens long, ids_crc32 long, path string, place int")


def encode_and_read(docs: DataFrame, tokenizer: str, key: str = "doc_id", **settings) -> DataFrame:
    """Write the grammar shards of ``docs`` and give what the files hold, without paths."""
    found = read(*write(docs, tokenizer, key, **settings))
    return found.select(F.col("id").alias(key), "start", "n_tokens", "ids_crc32")
