"""WARC: records written to, and read from, a table of chunks in the shared folder."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, store, table

#: Bytes of a record in one row of the table; longer records take several rows.
CHUNK = 1 << 16
#: So many groups of equal payloads, the largest, are matched by broadcast; any other has at most a 256th of all records.
HOT_GROUPS = 256
_content = re.compile(rb"\r\nContent-Length: (\d+)")
DDL = "archive int, record_no bigint, chunk_no int, last boolean, oversized boolean, data binary, running_crc32 bigint"
CHUNKS = pa.schema([("archive", pa.int32()), ("record_no", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("oversized", pa.bool_()), ("data", pa.binary()), ("running_crc32", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest())}>"


def decide(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with sha1 (of the payload, hexadecimal) and top: the largest page_id with that payload, null
    if no other row has it. Groups are aggregated before their shuffle, only those of two or more are kept, and the largest
    are joined by broadcast, so that a payload shared by a third of all rows makes no large task."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    groups = store(rows.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    hot = groups.orderBy(F.desc("n"), "sha1").limit(HOT_GROUPS).select("sha1", F.col("top").alias("hot_top"))
    rest = groups.join(F.broadcast(hot), "sha1", "left_anti").select("sha1", "top")
    return rows.join(F.broadcast(hot), "sha1", "left").join(rest, "sha1", "left").withColumn("top", F.coalesce("hot_top", "top")).drop("hot_top")


def _head(page_id, url, digest: str, n: int, top) -> bytes:
    revisit = top is not None and page_id != top
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(top, digest)}", f"X-Refers-To-Page-ID: {top}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(http) + (0 if revisit else n)}"]).encode() + b"\r\n\r\n" + http


def write_archives(decided: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Writes a WARC record a row: an archive for each partition, as rows (archive, record_no, chunk_no, data). The data of an
    archive's rows in order are its bytes. Payloads are sliced without copying them whole; each row has the CRC-32 of its
    record up to its end."""

    def run(batches):
        archive, no = TaskContext.get().partitionId(), 0
        rows, size = [], 0
        for b in batches:
            payloads = b.column(2)
            for k, (page_id, url, top) in enumerate(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(3).to_pylist())):
                body = memoryview(payloads[k].as_buffer() or b"")
                sha1 = hashlib.sha1()
                for at in range(0, len(body), chunk):
                    sha1.update(body[at : at + chunk])
                head = _head(page_id, url, base64.b32encode(sha1.digest()).decode(), len(body), top)
                body = body if top is None or page_id == top else body[:0]
                total = len(head) + len(body) + 4
                crc, ends = 0, list(range(chunk, total, chunk)) + [total]
                for n, end in enumerate(ends):
                    start, a = end - (end - 1) % chunk - 1, len(head)
                    data = head[start:end] + bytes(body[max(0, start - a) : max(0, end - a)]) + b"\r\n\r\n"[max(0, start - a - len(body)) : max(0, end - a - len(body))]
                    crc = zlib.crc32(data, crc)
                    rows.append((archive, no, n, end == total, total > chunk, data, crc))
                    if (size := size + len(data)) > 8_000_000:
                        yield _batch(rows, CHUNKS)
                        rows, size = [], 0
                no += 1
        if rows:
            yield _batch(rows, CHUNKS)

    decided.select("url", "page_id", "payload", "top").mapInArrow(run, DDL).write.option("compression", "zstd").parquet(path)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Reader:
    """Takes the chunks of one record in order; holds its head and the state of its digest only."""

    def __init__(self):
        self.head, self.sha1, self.n, self.crc, self.left = b"", hashlib.sha1(), 0, 0, None

    def add(self, data: bytes, running: int) -> None:
        self.crc = zlib.crc32(data, self.crc)
        if self.crc != running:
            raise ValueError("a chunk is damaged or missing")
        if self.left is None:
            self.head += data
            cut = self.head.find(b"\r\n\r\n")
            http = self.head.find(b"\r\n\r\n", cut + 4) if cut >= 0 else -1
            if http < 0:
                return
            self.fields = dict(x.split(b": ", 1) for x in self.head[:cut].split(b"\r\n")[1:])
            self.sent = int(_content.search(self.head, cut + 4, http)[1])
            self.left = int(self.fields[b"Content-Length"]) - (http - cut)
            data, self.head = self.head[http + 4 :], b""
        part = data[: self.left]
        self.sha1.update(part)
        self.left -= len(part)
        self.n += len(part)

    def row(self) -> tuple:
        kind, digest = self.fields[b"WARC-Type"].decode(), self.fields[b"WARC-Payload-Digest"].decode()[5:]
        if kind == "response" and (self.left or digest != base64.b32encode(self.sha1.digest()).decode() or self.n != self.sent):
            raise ValueError("a payload differs from its digest")
        page, refers = (self.fields.get(x) for x in (b"X-Page-ID", b"X-Refers-To-Page-ID"))
        return page and int(page), self.sent, digest, kind, refers and int(refers)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record that write_archives() wrote: page_id, payload_bytes and payload_digest of the full payload,
    record_type and refers_to. Digests of responses are computed from the bytes read, and a difference is an error. Records of
    one chunk are read where they lie; only the chunks of longer ones are dealt by record and sorted, then read as a stream."""

    def run(batches):
        reader, rows = None, []
        for b in batches:
            for n, last, data, running in zip(*(c.to_pylist() for c in b.columns)):
                if n == 0:
                    reader = _Reader()
                reader.add(data, running)
                if last:
                    rows.append(reader.row())
            if rows:
                yield _batch(rows, READ)
                rows = []

    chunks = spark.read.schema(DDL).parquet(path)
    need, out = ["chunk_no", "last", "data", "running_crc32"], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    whole = chunks.where("NOT oversized").select(*need)
    long = chunks.where("oversized").repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no").select(*need)
    return whole.mapInArrow(run, out).unionByName(long.mapInArrow(run, out))


def warc_round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC records and reads them back.

    Of records with equal payloads, that with the largest page_id is the response and the others revisit it. Null html: an empty
    payload, which counts like any other. Null url: an empty one. Null page_id: never the largest; rows without one that share
    their payload with no row that has one are responses. Repeated rows: a record each; all with the largest page_id of their
    payload are responses. Without rows there are none.
    """
    spark = pages.sparkSession
    write_archives(decide(pages), path := new_path(spark, "archives"), chunk)
    return read_archives(spark, path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


QUERIES = {"op7_warc": op7_warc}
ORACLE = {
    "op7_warc": r"""
WITH payloads AS (SELECT page_id::BIGINT AS page_id, encode(coalesce(html, '')) AS payload FROM pages),
digested AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM payloads),
bits AS (SELECT hex, unhex(hex)::BIT::VARCHAR AS b FROM (SELECT DISTINCT hex FROM digested)),
digests AS (SELECT hex, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: substr(b, (5 * k + j + 1)::BIGINT, 1)::INTEGER * (16 >> j::INTEGER))))::BIGINT, 1)), '') AS payload_digest FROM bits),
tops AS (SELECT hex, max(page_id) AS top FROM digested GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM digested JOIN digests USING (hex) JOIN tops USING (hex)
"""
}
