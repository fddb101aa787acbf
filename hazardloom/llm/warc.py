"""WARC archives: writer with revisit records, and a reader that salvages damaged files.

Writer: every task writes archives of gzip members, one record each, up to ``archive_bytes``. Of
records with equal payloads of at least ``revisit_bytes`` the one with the largest page id carries
the payload as a response, the others are revisits that refer to it.

Reader: a record counts if its head starts with a version line and holds fields only, its Content-Length
fits and its block digest matches; in a gzip member either the member's checksum is right or the record names
its digest. Members may hold any number of records, also all of a file. After a failed check the
reader searches for the next place where a member or version line starts, inside the member first, goes on there, and
logs the bytes between as quarantined. Files and members are read through windows, so memory follows the largest record.

Edge cases: heads have any length; null payloads are empty; null urls give no target line; rows without an id are responses or
revisit the largest id of their payload; rows with the same id and payload are all responses;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .shared import broadcast_if_small, file_system, qualified, small_batches, stored

VERSION, GZIP = b"WARC/1.1", b"\x1f\x8b\x08"
#: Members that inflate to more are inflated twice instead of being held.
HOLD = 4 << 20
REVISIT_BYTES, ARCHIVE_BYTES, CHUNK = 1000, 64 << 20, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

# ---- records ------------------------------------------------------------------------------------


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = dict(fields) | {"WARC-Block-Digest": _digest(block), "Content-Length": str(len(block))}
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in head.items()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, kind: str, refers: int | None, payload: bytes, sha1: str, name: str) -> bytes:
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>",
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))))
    if page is not None:
        fields["X-Page-Id"] = str(page)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page": str(refers)}
        return record(fields, http)
    return record(fields, http + payload)


def _parse(data: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, bytes used) of the record at the start of ``data``; None if a check fails."""
    line = _VERSION_LINE.match(data)
    if not line:
        return None
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for raw in data[line.end() : end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        return None
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[start:stop]
    named = fields.get("warc-block-digest")
    if named and named.startswith("sha1:") and named != _digest(block):
        return None
    return fields, block, stop + 4


# ---- salvage ------------------------------------------------------------------------------------


class _Window:
    """A seekable file with a forward window of bytes."""

    def __init__(self, source, size: int):
        self._f, self.size, self._at, self._data = source, size, 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self._at <= at and at + n <= self._at + len(self._data)):
            self._f.seek(at)
            self._at, self._data = at, self._f.read(max(n, min(CHUNK, self.size - at)))
        return self._data[at - self._at : at - self._at + n]


def _inflate(w: _Window, at: int) -> Iterator[tuple[bytes, int | None]]:
    """Pieces of the gzip member at ``at``; with the last one, where a member with a right checksum ends."""
    inflate, place, left = zlib.decompressobj(31), at, b""
    try:
        while not inflate.eof:
            chunk = left or w.bytes_at(place, CHUNK)
            place += 0 if left else len(chunk)
            piece = inflate.decompress(chunk, CHUNK)
            left = inflate.unconsumed_tail
            if not (chunk or piece or inflate.eof):
                return  # the file ends first
            yield piece, place - len(inflate.unused_data) if inflate.eof else None
    except zlib.error:
        return


class _Member:
    """The inflated bytes of the gzip member at ``at``, as far as they can be had, as a window.

    ``end`` is where the member ends in the file, None if it is damaged. Places asked for must not fall.
    """

    def __init__(self, w: _Window, at: int):
        self._w, self._start, self.size, self.end = w, at, 0, None
        self._at, self._data, self._more = 0, bytearray(), iter(())
        for piece, self.end in _inflate(w, at):
            self.size += len(piece)
            if self.size <= HOLD:
                self._data += piece
        if self.size > HOLD:
            self._data, self._more = bytearray(), _inflate(w, at)

    def bytes_at(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        while self._at + len(self._data) < at + n:
            if at - self._at > CHUNK:
                gone = min(at - self._at, len(self._data))
                del self._data[:gone]
                self._at += gone
            self._data += next(self._more)[0]
        return bytes(self._data[at - self._at : at - self._at + n])


def _head(w: _Window | _Member, at: int) -> bytes | None:
    """The version line and fields at ``at``, however long; None once a line is not a field."""
    n = 1 << 12
    while True:
        data = w.bytes_at(at, n)
        end = data.find(b"\r\n\r\n")
        lines = (data if end < 0 else data[:end]).split(b"\r\n")
        if not all(b":" in x for x in lines[1 : len(lines) - (end < 0)]):
            return None
        if end >= 0:
            return data[: end + 4]
        if at + n >= w.size:
            return None
        n *= 4


def _plain(w: _Window | _Member, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, end) of the uncompressed record at ``at``; None if a check fails."""
    if not _VERSION_LINE.match(w.bytes_at(at, 16)):
        return None
    head = _head(w, at)
    size = head and re.search(rb"(?im)^content-length[ \t]*:[ \t]*(\d{1,18})[ \t]*\r?$", head)
    if not size or at + len(head) + int(size[1]) + 4 > w.size:
        return None
    found = _parse(w.bytes_at(at, len(head) + int(size[1]) + 4))
    return found and (found[0], found[1], at + found[2])


def _next_start(w: _Window | _Member, at: int, members: bool = True) -> int:
    """The first place from ``at`` on that looks like a version line or a member; else the end."""
    overlap = 16
    while at < w.size:
        data = w.bytes_at(at, CHUNK)
        line = _VERSION_LINE.search(data)
        found = [i for i in (data.find(GZIP) if members else -1, line.start() if line else -1) if i >= 0]
        if found:
            return at + min(found)
        if at + len(data) >= w.size:
            break
        at += len(data) - overlap
    return w.size


def _records(m: _Member) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None]]:
    """(start, end, fields, block) of a member's records, in its inflated bytes; gaps have no fields.

    A damaged member gives those whose own digest shows that they are whole.
    """
    at, bad = 0, -1
    while at < m.size:
        found = _plain(m, at)
        if found and m.end is None and not found[0].get("warc-block-digest", "").startswith("sha1:"):
            found = None
        if found:
            if bad >= 0:
                yield bad, at, None, None
                bad = -1
            yield at, found[2], found[0], found[1]
            at = found[2]
        else:
            bad = at if bad < 0 else bad
            at = _next_start(m, at + 1, members=False)
    if bad >= 0:
        yield bad, m.size, None, None


def salvage(source, size: int) -> Iterator[tuple]:
    """('record' or 'gap', start, end, fields, block, inner start, inner end), all bytes of the file in order.

    Gaps have neither fields nor block. What comes from a member has the member's bytes as start and end and its place
    in the inflated bytes as inner ones (else null); a record of a damaged member ends where the member
    starts, since its gap holds all of the member's bytes.
    """
    w, at, bad = _Window(source, size), 0, -1
    while at < size:
        if w.bytes_at(at, 3) == GZIP:
            member = _Member(w, at)
            end = member.end
            rows = _records(member)
        else:
            found = _plain(w, at)
            end = found and found[2]
            rows = iter([(None, None, found[0], found[1])] if found else [])
        some, skipped = False, []
        for a, b, fields, block in rows:
            if not fields:
                skipped.append((a, b))
                continue
            if bad >= 0:
                yield "gap", bad, at, None, None, None, None
                bad = -1
            some = True
            if end is not None:
                yield from (("gap", at, end, None, None, *x) for x in skipped)
            skipped = []
            yield "record", at, at if end is None else end, fields, block, a, b
        if some and end is not None:
            yield from (("gap", at, end, None, None, *x) for x in skipped)
            at = end
        else:
            bad = at if bad < 0 else bad
            at = _next_start(w, at + 1)
    if bad >= 0:
        yield "gap", bad, size, None, None, None, None


# ---- Spark --------------------------------------------------------------------------------------


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Per row: id, url, payload bytes and digest, record type, and the id a revisit refers to."""
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    owner = (
        rows.where(F.octet_length("body") >= least)
        .groupBy(F.col("sha1").alias("d"))
        .agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and owner is not null")
    )
    # only payloads that repeat are listed, the bodies stay where they are
    owner = stored(owner, "warc-owners")
    joined = rows.join(broadcast_if_small(owner, 80), F.col("sha1") == F.col("d"), "left")
    revisit = F.col("owner").isNotNull() & ~F.coalesce(F.col("id") == F.col("owner"), F.lit(False))
    return joined.select(
        "id", "url", F.when(revisit, F.lit("revisit")).otherwise("response").alias("kind"),
        F.when(revisit, F.col("owner")).alias("refers"),
        F.when(~revisit, F.col("body")).alias("body"), "sha1",
    )


def write(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned records; the committed list of archives (path, bytes)."""
    small_batches(planned.sparkSession)
    folder = qualified(planned.sparkSession, folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, path, used, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out
            out.close()
            out = None
            return pa.record_batch([pa.array([path]), pa.array([used], pa.int64())], names=["path", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, kind, refers, body, sha1 = (batch.column(c)[i].as_py() for c in range(6))
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    path, used = f"{folder}/{name}", 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = page_record(page, url, kind, refers, body or b"", sha1, f"{path}#{n}")
                squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = squeeze.compress(data) + squeeze.flush()
                out.write(data)
                used, n = used + len(data), n + 1
                if used >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return stored(planned.mapInArrow(task, "path string, bytes long"), "warc-manifest")


_READ = (
    "path string, kind string, start long, end long, inner_start long, inner_end long, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def read(archives: DataFrame) -> DataFrame:
    """One row per record and per quarantined gap of the archives (path, bytes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = file_system(path)
                rows: list[tuple] = []
                with fs.open_input_file(where) as source:
                    for kind, start, end, fields, block, *inner in salvage(source, size):
                        rows.append((path, kind, start, end, *inner, *(_page(fields, block) if fields else (None,) * 5)))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # a stated number of tasks: the rows are few and small, the files behind them are not
    spark = archives.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return archives.repartition(tasks, "path").mapInArrow(task, _READ)


def _page(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type")
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    if kind == "revisit":
        named = fields.get("warc-payload-digest", "")
        digest = base64.b32decode(named[5:]).hex() if named.startswith("sha1:") else None
        return number("x-page-id"), None, digest, kind, number("x-refers-to-page")
    payload = block.partition(b"\r\n\r\n")[2]
    return number("x-page-id"), len(payload), hashlib.sha1(payload).hexdigest(), kind, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.record_batch(
        [pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows), _READ.split(", "))], names=names
    )


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", **limits) -> DataFrame:
    """Write an archive record per page, read all archives back, and give the records."""
    archives = write(plan(pages, key, url, payload), scratch_path(pages.sparkSession, "warc"), **limits)
    found = stored(read(archives).where("kind = 'record'").drop("kind", "path", "start", "end", "inner_start", "inner_end"), "warc-records")
    responses, revisits = (found.where(F.col("record_type") == x) for x in ("response", "revisit"))
    # a revisit's payload is the one of its response; only payloads that repeat are looked up
    named = stored(revisits.select(F.col("payload_digest").alias("d")).distinct(), "warc-revisited")
    whole = responses.join(broadcast_if_small(named, 100), F.col("payload_digest") == F.col("d"))
    whole = stored(whole.groupBy("d").agg(F.max("payload_bytes").alias("n")), "warc-lengths")
    revisits = revisits.join(broadcast_if_small(whole, 110), F.col("payload_digest") == F.col("d"), "left")
    full = revisits.select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select(full.columns).unionByName(full).withColumnRenamed("page_id", key)
