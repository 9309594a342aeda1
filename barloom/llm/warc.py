"""WARC archives written and read back through a chunked record table.

``write_archives`` deduplicates by payload digest (SHA-1): among records with
equal payloads of at least ``min_bytes`` bytes the one with the smallest id is
the ``response`` and the others become ``revisit`` records that name it.  Only
digests and ids meet by digest: the aggregation combines before its shuffle, and its
result is a table before it is joined to the ids, so that the join has an exchange on both
sides and Spark can split it where a digest is hot.  Payloads are joined to what their
page refers to by page id and digest, never dealt by digest alone.

``read_chunks`` streams archives as the chunked record table: one row per
``(record, chunk_no)`` of at most ``chunk_bytes`` payload bytes, with the SHA-1
and byte count of the payload *so far*, so the last chunk's row carries the
record's digest and no record is ever held whole.  Each record is its own gzip
member.  Archives go to the shared folder under a name that is unique to the
task attempt; the manifest lists only those of the attempts that succeeded, so a
lost executor costs a rerun and no duplicates.

Null and empty payloads are records of 0 bytes.  A null id is written as an
empty id and read back as null; null ids never refer and are never referred to.
Rows that repeat an id and a payload are all of the same type.  A null url is
written as an empty target.  An empty table gives no archives and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, batch, map_batches, table

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
GZIP = 16 + zlib.MAX_WBITS

MANIFEST = "archive string, records long, bytes long"
_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def revisits(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """``page_id, _sha1, refers_to`` of every page and payload that refers to another page's."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    large = pages.filter(F.col("page_id").isNotNull() & (F.length(payload) >= min_bytes))
    ids = scratch.keep(large.select(F.col("page_id").cast("long"), F.sha1(payload).alias("_sha1")), "digests")
    first = ids.groupBy("_sha1").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).filter("refers_to < _last").drop("_last")
    first = scratch.keep(first, "firsts")
    return scratch.keep(ids.join(first, "_sha1").filter("page_id <> refers_to").distinct(), "revisits")


def record_types(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``; refers_to is null for responses."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    # null ids match nothing; their urls spread them
    rows = rows.withColumn("_sha1", F.when(F.col("page_id").isNull(), F.concat(F.lit("-"), F.coalesce("url", F.lit("")))).otherwise(F.sha1("payload")))
    return rows.join(revisits(pages, scratch, min_bytes), ["page_id", "_sha1"], "left").select("page_id", "url", "payload", "refers_to")


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_parts(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of one record: its head, then its block in chunks."""
    view = memoryview(payload)
    sha1 = hashlib.sha1()
    for at in range(0, len(view), chunk_bytes):
        sha1.update(view[at : at + chunk_bytes])
    target = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(sha1.digest())}",
        f"WARC-Payload-Length: {len(view)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    length = len(view) if refers_to is None else 0
    yield "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", "", ""]).encode()
    for at in range(0, length, chunk_bytes):
        yield bytes(view[at : at + chunk_bytes])
    yield b"\r\n\r\n"


class ArchiveWriter:
    """Rolls archives of about ``ARCHIVE_BYTES`` in a folder that Spark's tasks share."""

    def __init__(self, folder: str, name: str, level: int = 4):
        self.folder, self.name, self.level = folder, name, level
        self.out, self.done = None, []

    def add(self, parts: Iterator[bytes]) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{self.name}-{len(self.done):05d}.warc.gz"
            fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
            fs.create_dir(os.path.dirname(path), recursive=True)
            self.out, self.records = fs.open_output_stream(path, compression=None), 0
        member = zlib.compressobj(self.level, zlib.DEFLATED, GZIP)
        for part in parts:
            self.out.write(member.compress(part))
        self.out.write(member.flush())
        self.records += 1
        if self.out.tell() >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.done.append((self.path, self.records, size))
            self.out = None


def write_archives(scratch: Scratch, pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` as archives below ``folder``; returns the lazily written manifest."""

    def run(batches):
        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    writer.add(record_parts(page_id, url, payload, refers_to, chunk_bytes))
        writer.close()
        yield batch(_MANIFEST, *(list(c) for c in zip(*writer.done))) if writer.done else batch(_MANIFEST, [], [], [])

    return map_batches(record_types(pages, scratch, min_bytes), run, MANIFEST)


CHUNKS = "archive string, record_no long, page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, data binary, bytes_so_far long, sha1_so_far string, declared_sha1 string, declared_bytes long"
_CHUNKS = pa.schema(
    [("archive", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary())]
    + [("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("declared_sha1", pa.string()), ("declared_bytes", pa.int64())]
)


class Source:
    """The plain bytes of a file of gzip members, a bounded buffer at a time."""

    def __init__(self, uri: str, buffer: int = 1 << 18):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file, self.buffer = fs.open_input_stream(path, compression=None), buffer
        self.member, self.packed, self.plain = None, b"", bytearray()

    def more(self) -> bool:
        """Decompress at most ``buffer`` further bytes; false at the end."""
        while True:
            if not self.packed:
                self.packed = self.file.read(self.buffer)
                if not self.packed:
                    if self.member is not None:
                        raise ValueError("the archive ends inside a member")
                    return False
            if self.member is None:
                self.member = zlib.decompressobj(GZIP)
            got = self.member.decompress(self.packed, self.buffer)
            if self.member.eof:
                self.packed, self.member = self.member.unused_data, None
            else:
                self.packed = self.member.unconsumed_tail
            if got:
                self.plain += got
                return True

    def head(self) -> dict[str, str] | None:
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.plain:
                    raise ValueError("the archive ends inside a record's head")
                return None
        lines = bytes(self.plain[:end]).decode().split("\r\n")
        del self.plain[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record's block")
        got = bytes(self.plain[:n])
        del self.plain[:n]
        return got


def _id(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def chunks_of(uri: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The chunked record table of one archive."""
    source, record_no = Source(uri), 0
    while (head := source.head()) is not None:
        left, sha1, chunk_no, so_far = int(head["content-length"]), hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(left, chunk_bytes))
            left -= len(data)
            so_far += len(data)
            sha1.update(data)
            yield (
                uri, record_no, _id(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], _id(head.get("warc-refers-to")), chunk_no, not left, data,
                so_far, sha1_base32(sha1.digest()), head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"]),
            )
            chunk_no += 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record isn't closed")
        record_no += 1


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of all archives of a manifest."""

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, held = [], 0
                for row in chunks_of(uri, chunk_bytes):
                    rows.append(row)
                    held += len(row[8]) + 200
                    if held > 4 * chunk_bytes:
                        yield batch(_CHUNKS, *(list(c) for c in zip(*rows)))
                        rows, held = [], 0
                if rows:
                    yield batch(_CHUNKS, *(list(c) for c in zip(*rows)))

    return map_batches(manifest.select("archive"), run, CHUNKS)


def summaries(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk; a response's own bytes are what counts, not its head."""
    whole = F.col("record_type") == "response"
    return chunks.filter("last").select(
        "page_id",
        F.when(whole, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("sha1_so_far")).otherwise(F.col("declared_sha1")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write archives to the shared folder, then return their chunked record table."""
    scratch = Scratch(spark, "warc")
    manifest = scratch.keep(write_archives(scratch, pages, scratch.path("archives"), min_bytes, chunk_bytes), "manifest")
    return read_chunks(manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive"), chunk_bytes)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(round_trip(spark, table(spark, sf_dir, "pages")))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first_id FROM d GROUP BY x)
SELECT d.page_id AS page_id, d.payload_bytes AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_B32}',
         (((('0x' || substr(d.x || '0', 1 + (i * 5) // 4, 2))::BIGINT >> (3 - (i * 5) % 4)) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM d JOIN f USING (x)
"""
