"""WARC archives: deduplicated records, normalised from one gzip stream to a member per record, with an offset index.

``write_archives`` writes each partition's records as one whole-file gzip stream, the way crawl tools that pipe through
gzip leave them.  ``normalise`` inflates such a file once from front to back, finds each record by its headers, rewrites
every record as a gzip member of its own and writes a sidecar index (offset, compressed length, record id).
``read_archives`` seeks to members by the sidecar and reads each record alone.  Memory is bounded by one record.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeyard.llm.common import open_folder, publish, register, shared_path, stored, table

CHUNK = 1 << 18
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
INDEX_ROW = "<qqq"                       # offset, compressed length, number of the record
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_record_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds payload, record_type and refers_to: of equal payloads the smallest page_id is the response.

    Only (hash, length, page_id) is grouped, summed up before the shuffle; a payload that many pages share makes a
    skewed join side, which adaptive execution splits.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    firsts = rows.select("page_id", "key", "size").groupBy("key", "size").agg(F.min("page_id").alias("first"))
    revisit = (F.col("size") >= min_bytes) & (F.col("page_id") != F.col("first"))
    return (rows.join(firsts, ["key", "size"], "left")
            .select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to")))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP headers alone, its payload stands in the record it refers to."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in (url or "") if c >= " ").encode()
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id),
            b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + uri,
            b"WARC-Payload-Digest: sha1:" + digest_of(payload).encode(),
            b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to,
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in raw.split(b"\r\n")[1:])}


def inflated(source) -> Iterator[bytes]:
    """Content of a gzip file of any number of members, chunk by chunk."""
    stream = zlib.decompressobj(31)
    while raw := source.read(CHUNK):
        while raw:
            if out := stream.decompress(raw, CHUNK * 4):
                yield out
            if stream.eof:
                raw = stream.unused_data
                stream = zlib.decompressobj(31)
            else:
                raw = stream.unconsumed_tail
    if not stream.eof and (rest := stream.flush()):
        yield rest


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, found by Content-Length."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(headers(bytes(held[:at]))[b"content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("archive ends inside a record")


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """One whole-file gzip archive per partition; returns (path), one row per file, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is None:
            return
        files, root = open_folder(folder)
        path = f"{root}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"

        def write(out) -> None:
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in _chain(first, filled):
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
                for i in range(batch.num_rows):
                    out.write(packer.compress(record(*(c[i].as_py() for c in columns))))
            out.write(packer.flush())

        publish(files, path, write)
        yield pa.RecordBatch.from_pydict({"path": [posixpath.basename(path)]})

    return stored(records.mapInArrow(run, "path string"), "archives")


def _chain(first, rest):
    yield first
    yield from rest


def _spread(files: DataFrame) -> DataFrame:
    """One task per file: the table of files is a few rows."""
    return files.repartition(max(1, files.count()))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive with a member per record and its sidecar; returns (path, index), one row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out_path = f"{root}/{path[:-8]}-{TaskContext.get().taskAttemptId()}.members.warc.gz"
                rows: list[bytes] = []

                def write(out) -> None:
                    at = 0
                    with files.open_input_stream(f"{root}/{path}", compression=None) as source:
                        for number, content in enumerate(split_records(inflated(source))):
                            packed = member(content)
                            out.write(packed)
                            rows.append(struct.pack(INDEX_ROW, at, len(packed), number))
                            at += len(packed)

                publish(files, out_path, write)
                publish(files, out_path + ".index", lambda out: out.write(b"".join(rows)))
                yield pa.RecordBatch.from_pydict({"path": [posixpath.basename(out_path)],
                                                  "index": [posixpath.basename(out_path) + ".index"]})

    return stored(_spread(archives).mapInArrow(run, "path string, index string"), "members")


def read_record(content: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record."""
    at = content.index(b"\r\n\r\n")
    head = headers(content[:at])
    block = content[at + 4:at + 4 + int(head[b"content-length"])]
    body = block.index(b"\r\n\r\n") + 4
    size = int(headers(block[:body - 4])[b"content-length"])
    digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    kind = head[b"warc-type"].decode()
    if kind == "response" and (len(block) - body != size or digest_of(block[body:]) != digest):
        raise ValueError("payload doesn't match its digest")
    page, other = (head.get(k, b"").rpartition(b":")[2].rstrip(b">") for k in (b"warc-record-id", b"warc-refers-to"))
    return None if page == b"null" else int(page), size, digest, kind, int(other) if other else None


def read_archives(members: DataFrame, folder: str) -> DataFrame:
    """Every record, read alone from its member."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                with files.open_input_stream(f"{root}/{index}", compression=None) as f:
                    places = list(struct.iter_unpack(INDEX_ROW, f.read()))
                rows = []
                with files.open_input_file(f"{root}/{path}") as f:
                    for at, length, _ in places:
                        f.seek(at)
                        rows.append(read_record(zlib.decompress(f.read(length), 31)))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)],
                                                             schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)],
                                                     schema=schema)

    return _spread(members).mapInArrow(run, SCHEMA)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back all pages.

    A null html is the empty payload and takes part in deduplication; a null url is an empty target; a null page_id
    stays null and is always a response; rows that repeat the smallest page_id of a payload are all responses; an
    empty table gives no file and no rows; further columns are ignored.
    """
    folder = shared_path(pages.sparkSession, "warc")
    written = write_archives(with_record_types(pages, min_bytes), folder)
    return read_archives(normalise(written, folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)),
           lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@register("op6_warc", ORACLE)
def op6_warc(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages"))
