"""WARC archives as chunked record tables.

An archive is a table of rows (archive, record_id, chunk, of, data, running_sha256): the data of its rows, in order, is
a WARC/1.1 file. A record is cut into chunks of bounded size, so no task holds the serialised form of a large record;
each row also carries the digest of the payload up to and including it. Records of one chunk are read where they lie;
only those of several chunks are brought together, sorted, and streamed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CHUNK_BYTES = 256 << 10
#: Payloads below this size are never replaced by a revisit.
LEAST_REVISIT = 100
CRLF = b"\r\n"
#: Repeated payloads (about 200 bytes each) that may be broadcast.
MAX_BROADCAST = 100_000
#: Longest header that the reader accepts.
HEADER_BYTES = 16 << 10

CHUNKS = "archive long, record_id long, chunk int, of int, data binary, running_sha256 string"


def plan_records(pages: DataFrame, scratch: Scratch | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses). Of equal payloads (by length and SHA-256) of at
    least `least` bytes the smallest page_id is the response. Rows that repeat that page_id are responses too. Null html
    is an empty payload; a row of null page_id revisits the smallest id, if there is one. Payloads that repeat are
    found by digest alone; their table is broadcast if it is small (and there is a scratch folder to count it in), else joined on digests, where rows that cannot be
    revisits are spread by a salt."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    key = F.concat_ws(":", "digest", "size").alias("key")
    first = rows.where(F.col("size") >= least).groupBy(key).agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").select("key", "response")
    if scratch is not None:
        first = scratch.write(first)
        first = F.broadcast(first) if first.count() <= MAX_BROADCAST else first
    keyed = rows.withColumn("key", F.when(F.col("size") >= least, key).otherwise(F.concat_ws(":", F.lit("-"), F.xxhash64("page_id", "url"))))
    joined = keyed.join(first, "key", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def record_name(page_id: int, digest: str) -> str:
    """Id of a response. Rows that repeat a page_id and its payload share it."""
    return f"<urn:page:{page_id}:{digest[:32]}>"


def header(page_id: int | None, url: str | None, payload_size: int, digest: str, refers_to: int | None, record: str) -> tuple[bytes, bytes]:
    """WARC header with its blank line, and the HTTP header that begins the block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_size
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = record_name(page_id, digest) if refers_to is None and page_id is not None else f"<urn:record:{record}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is None or target != url:  # a header can't hold it as it is
        lines.append(f"X-Target-URI: {json.dumps(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to, digest)}"]
    length = len(http) + (payload_size if refers_to is None else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + CRLF * 2, http


def _write(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive = TaskContext.get().partitionId()
        serial, rows, held = 0, [], 0
        for batch in batches:
            payloads = batch.column(batch.schema.get_field_index("payload"))
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for i in range(len(batch)):
                payload = memoryview(payloads[i].as_buffer())
                head, http = header(ids[i], urls[i], len(payload), digests[i], refers[i], f"{archive}-{serial}")
                record_id = (archive << 40) | serial
                serial += 1
                body = payload if refers[i] is None else payload[:0]
                of, sha = max(1, -(-len(body) // chunk_bytes)), hashlib.sha256()
                for k in range(of):
                    piece = body[k * chunk_bytes : (k + 1) * chunk_bytes]
                    sha.update(piece)
                    data = b"".join([head + http if k == 0 else b"", piece, CRLF * 2 if k + 1 == of else b""])
                    rows.append((archive, record_id, k, of, data, sha.copy().hexdigest()))
                    held += len(data)
                    if held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "record_id", "chunk", "of", "data", "running_sha256"])


def write_archives(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of records as from plan_records; every task writes one archive."""
    return records.mapInArrow(_write(chunk_bytes), CHUNKS)


class RecordReader:
    """Takes a record's bytes piece by piece; keeps the header and a running digest, never the payload."""

    def __init__(self):
        self.head, self.fields, self.left, self.size, self.sha, self.http = b"", None, 0, 0, hashlib.sha256(), b""
        self.in_payload = False

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(CRLF * 2)
            if end < 0:
                if len(self.head) > HEADER_BYTES:
                    raise ValueError("no end of a WARC header")
                return
            lines = self.head[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record")
            self.fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            self.left = int(self.fields["content-length"])
            data, self.head = self.head[end + 4 :], b""
        block = data[: self.left]
        self.left -= len(block)
        if not self.in_payload:
            self.http += block
            end = self.http.find(CRLF * 2)
            if end < 0:
                return
            block, self.http, self.in_payload = self.http[end + 4 :], b"", True
        self.sha.update(block)
        self.size += len(block)

    def row(self) -> tuple:
        if self.fields is None or self.left:
            raise ValueError("a record ends early")
        f, revisit = self.fields, self.fields["warc-type"] == "revisit"
        stated = f["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and stated != self.sha.hexdigest():
            raise ValueError("a payload doesn't match its digest")
        refers = f.get("warc-refers-to")
        page = f.get("x-page-id")
        url = json.loads(f["x-target-uri"]) if "x-target-uri" in f else f["warc-target-uri"]
        return (page and int(page)), url, f["warc-type"], (None if revisit else self.size), stated, refers and int(refers.split(":")[2])


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (record_id, chunk)."""
    reader, expected, key = None, 0, None
    for batch in batches:
        out = []
        data = batch.column(batch.schema.get_field_index("data"))
        for i, (record, chunk, of, running) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("record_id", "chunk", "of", "running_sha256")))):
            if chunk == 0:
                if reader is not None:
                    raise ValueError("a record ends early")
                reader, expected, key = RecordReader(), 0, record
            if reader is None or record != key or chunk != expected:
                raise ValueError("a chunk is missing")
            reader.feed(data[i].as_py())
            if reader.sha.hexdigest() != running:
                raise ValueError("a chunk doesn't match its digest")
            expected += 1
            if expected == of:
                out.append(reader.row())
                reader = None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])
    if reader is not None:
        raise ValueError("a record ends early")


def read_archives(chunks: DataFrame) -> DataFrame:
    """The records of a chunk table; payload_bytes of a revisit is null, as it has no payload."""
    whole = chunks.where("of = 1").mapInArrow(_read, RECORDS)
    cut = chunks.where("of > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(_read, RECORDS)
    return whole.union(cut)


def export_archive(chunks: DataFrame, archive: int, path: str) -> None:
    """One archive as a WARC file on the driver's file system, streamed chunk by chunk."""
    with open(path, "wb") as f:
        for row in chunks.where(F.col("archive") == archive).orderBy("record_id", "chunk").select("data").toLocalIterator():
            f.write(row.data)


def archive_pages(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every row, after its record was written
    to an archive and read back; a revisit's size is that of the response it refers to."""
    with Scratch(pages.sparkSession) as scratch:
        chunks = scratch.write(write_archives(plan_records(pages, scratch), chunk_bytes))
        records = scratch.write(read_archives(chunks))
        sizes = records.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"))
        needed = records.where("refers_to is not null").select("refers_to", F.col("payload_digest").alias("digest")).distinct()
        sizes = sizes.join(needed, ["refers_to", "digest"], "left_semi").distinct().withColumnRenamed("digest", "payload_digest")
        found = records.join(sizes, ["refers_to", "payload_digest"], "left")
        out = found.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
        return scratch.write(out, keep=True)
