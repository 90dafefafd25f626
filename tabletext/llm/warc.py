"""WARC archives: a writer, and a sequential reader with one gzip member per record.

An archive is a row (path, content) as ``binaryFile`` gives it, so stored segments and files of others read alike. The
reader inflates one member at a time in bounded pieces, frames the block by Content-Length and verifies the digests.

Edge cases: a null or empty payload is a response of length 0; a payload under ``REVISIT_MIN`` bytes is never a revisit;
repeated rows of the page with the largest id are all responses; an empty table gives no record. A record that is
cut off, malformed or does not match its digest is returned with ``error`` set, and reading goes on with the next member.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.llm.common import read, written

#: Payloads of at least so many bytes are stored once; records with an equal one refer to it.
REVISIT_MIN = 1000
#: A segment is closed at the first record boundary beyond so many compressed bytes.
SEGMENT_BYTES = 4_000_000
READ_BYTES = 64 * 1024
DATE = "2024-01-01T00:00:00Z"
SEGMENT = "path string, content binary"
RECORD = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_length long, payload_digest string, payload binary, error string"
)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP head, the length and the digest, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    uri = uri.encode("ascii", "backslashreplace").decode().replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head.insert(-1, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(-1, f"WARC-Refers-To: <{refers_to}>")
    data = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_type, record_id, target_uri, refers_to, payload) rows to archive segments."""
    out = pa.schema([("path", pa.string()), ("content", pa.binary())])
    parts, size = [], 0

    def segment() -> pa.RecordBatch:
        content = b"".join(parts)
        return pa.RecordBatch.from_pylist([{"path": f"{hashlib.sha1(content).hexdigest()}.warc.gz", "content": content}], out)

    for batch in rows:
        for i in range(batch.num_rows):  # a row at a time: payloads are not copied together
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            parts.append(
                record_bytes(row["record_type"], row["record_id"], row["target_uri"] or "", row["payload"] or b"", row["refers_to"])
            )
            size += len(parts[-1])
            if size >= SEGMENT_BYTES:
                yield segment()
                parts, size = [], 0
    if parts:
        yield segment()


def members(content: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset, inflated bytes and error of each gzip member, in order."""
    at = 0
    while at < len(content):
        if content[at : at + 2] != b"\x1f\x8b":
            nxt = content.find(b"\x1f\x8b\x08", at + 1)
            nxt = len(content) if nxt < 0 else nxt
            yield at, b"", "not a gzip member"
            at = nxt
            continue
        inflate, out, pos, error = zlib.decompressobj(31), [], at, None
        try:
            while not inflate.eof and pos < len(content):
                piece = content[pos : pos + READ_BYTES]
                out.append(inflate.decompress(piece))
                pos += len(piece)
            if not inflate.eof:
                error = "gzip member cut off"
            end = pos - len(inflate.unused_data)
        except zlib.error as e:
            error, end = f"bad gzip member: {e}", content.find(b"\x1f\x8b\x08", at + 3)
            end = len(content) if end < 0 else end
        yield at, b"".join(out), error
        at = end


def parse_record(data: bytes) -> dict:
    """Header, block by Content-Length, and payload of one inflated record; ``error`` says what does not hold."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out = {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
    }
    if not mark or not lines[0].startswith("WARC/"):
        return out | {"error": "no WARC header"}
    length = fields.get("content-length", "")
    if not length.isdigit():
        return out | {"error": "no Content-Length"}
    block = rest[: int(length)]
    if len(block) < int(length) or rest[int(length) :] != b"\r\n\r\n":
        return out | {"error": "block does not match Content-Length"}
    if fields.get("warc-block-digest", f"sha1:{_digest(block)}") != f"sha1:{_digest(block)}":
        return out | {"error": "block digest does not match"}
    payload = block
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        out["payload_length"] = int(told[0]) if told and told[0].isdigit() else len(payload)
    else:
        out["payload_length"] = len(payload)
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] != "revisit":
        out["payload"] = payload
        if declared and declared != _digest(payload):
            return out | {"error": "payload digest does not match"}
        declared = declared or _digest(payload)
    try:
        out["payload_digest"] = base64.b32decode(declared).hex() if len(declared) == 32 else declared.lower() or None
    except ValueError:
        out["error"] = "payload digest cannot be read"
    return out


def read_archives(archives: DataFrame) -> DataFrame:
    """Archives (path, content) to records, each archive read from its start by one task."""
    names = ["path", "offset", "record_type", "record_id", "target_uri", "refers_to", "payload_length", "payload_digest", "payload", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, data, error in members(content.as_py() or b""):
                    row = dict.fromkeys(names) | (parse_record(data) if not error else {"error": error})
                    rows.append(row | {"path": path.as_py(), "offset": offset})
                    size += len(data)
                    if size >= SEGMENT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path", "content").mapInArrow(run, RECORD)


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Decide response or revisit for each page: equal payloads are found by digest and length, the largest key answers."""
    rows = pages.select(
        F.col(key).alias("key"), F.col(uri).alias("target_uri"), F.encode(F.coalesce(payload, F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    # grouped and written before it is joined: a digest that many rows share is one row here, and Spark can split the other side
    groups = written(
        rows.where(F.length("payload") >= REVISIT_MIN)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.max("key").alias("answer"), F.count(F.lit(1)).alias("times"))
        .where("times > 1"),
        "warc-groups",
    )
    revisit = F.col("answer").isNotNull() & ~F.col("key").eqNullSafe(F.col("answer"))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.join(groups, F.col("digest") == F.col("same"), "left").select(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.coalesce(urn(F.col("key")), F.lit("urn:page:")).alias("record_id"),
        "target_uri",
        F.when(revisit, urn(F.col("answer"))).alias("refers_to"),
        "payload",
    )


def write_archives(records: DataFrame) -> DataFrame:
    """Record rows to archive segments in the shared folder."""
    return written(records.mapInArrow(write_segments, SEGMENT), f"warc-{uuid.uuid4().hex[:8]}")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, and return what the records say."""
    pages = read(spark, sf_dir, "pages")
    records = read_archives(write_archives(plan_records(pages)))
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    return records.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "error",
    )


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS answer FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN answer IS NOT NULL AND answer <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN answer <> page_id THEN answer END AS refers_to, NULL::VARCHAR AS error
FROM p LEFT JOIN g ON p.d = g.d
"""
