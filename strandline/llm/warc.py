"""WARC archives: one gzip member per record, written in the shared folder and read back sequentially.

Each task writes archives of about `roll` bytes under names of their own and reports them in a manifest. The manifest is
checkpointed before anything reads, so archives of failed attempts are never read and a lost executor
changes nothing. The reader streams an archive in blocks, inflates one gzip member at a time with an
incremental zlib object, frames the record by its Content-Length and verifies block and payload digests.

Of records with equal payloads of at least `least_bytes` bytes, the one with the largest page_id is the
response and the others are revisits that refer to it. This is decided on digests and ids alone; payloads are never
dealt by content, so a page with very many copies is written by many tasks.

Defined cases: null html is an empty payload; page_id is the record's identity, and rows that repeat the
largest page_id of their payload are all responses; null page_ids are never referred to unless all of
the group are null, and then all are responses; an empty table gives an empty result; extra columns are
ignored; pages of any length are one record, of which a task holds one at a time; a damaged archive fails the read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_dir, table

LEAST_BYTES, BLOCK, LEVEL, ROLL = 1000, 1 << 16, 4, 1 << 30
#: Revisits up to this number, at most some 60 MB, go to all tasks; more meet the pages in a shuffle by id and digest.
BROADCAST_REVISITS = 1_000_000


def _open(path: str, mode: str):
    """A stream on any file system that the workers know ('w' to write, 'r' to read on, 'at' to seek); plain paths are local."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if urlsplit(path).scheme else "file://" + path)
    if mode == "w":
        where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return where.open_output_stream(inner, compression=None)
    if mode == "at":
        return where.open_input_file(inner)
    return where.open_input_stream(inner, compression=None)


def b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC record as a gzip member. page_id is kept in the record's id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(url.split()),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {b32(payload)}",
        f"WARC-Block-Digest: {b32(block)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    pack = zlib.compressobj(LEVEL, wbits=31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(read) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time. `read(n)` gives up to n bytes."""
    data = read(BLOCK)
    while data:
        z, out = zlib.decompressobj(wbits=31), []
        while not z.eof:
            if not data:
                raise EOFError("archive ends within a record")
            out.append(z.decompress(data))
            data = z.unused_data if z.eof else read(BLOCK)
        yield b"".join(out)
        data = data or read(BLOCK)


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one record, its framing and digests verified."""
    at = raw.index(b"\r\n\r\n")
    if not raw.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head = fields(raw[:at])
    size = int(head["content-length"])
    block = raw[at + 4 : at + 4 + size]
    if len(block) != size or raw[at + 4 + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if b32(block) != head["warc-block-digest"]:
        raise ValueError("block digest differs")
    cut = block.index(b"\r\n\r\n")
    http, payload = fields(block[:cut]), block[cut + 4 :]
    if head["warc-type"] == "response":
        if int(http["content-length"]) != len(payload) or b32(payload) != head["warc-payload-digest"]:
            raise ValueError("payload digest or length differs")
    elif payload:
        raise ValueError("a revisit has a payload")
    return head, http, payload


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, roll: int = ROLL) -> DataFrame:
    """Write archives under `folder`; the checkpointed manifest (path, records, bytes)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        html.alias("payload"),
        F.unhex(F.sha2(html, 256)).alias("content"),
    )
    large = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "content")
    each = large.groupBy("content", "page_id").agg(F.count("*").alias("n")).checkpoint()
    again = each.groupBy("content").agg(F.max("page_id").alias("latest"), F.sum("n").alias("n")).where("n > 1").select("content", "latest")
    revisits = each.join(again, "content").where(~F.col("page_id").eqNullSafe(F.col("latest")))
    revisits = revisits.select(F.col("page_id").alias("of"), F.col("content").alias("with"), F.col("latest").alias("refers_to")).checkpoint()
    small = revisits.count() <= BROADCAST_REVISITS
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("with"))
    decided = rows.join(F.broadcast(revisits) if small else revisits, same, "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, records, size = "", None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if out and size >= roll:
                    yield done()
                    out, records, size = None, 0, 0
                if not out:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = _open(path, "w")
                member = record(*values)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out:
            yield done()

    return decided.mapInArrow(run, "path string, records long, bytes long").checkpoint()


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's archives."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ]
    )
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen, held = [], 0, 0
                with _open(path, "r") as stream:
                    for raw in members(stream.read):
                        head, http, payload = parse(raw)
                        digest = base64.b32decode(head["warc-payload-digest"][5:]).hex()
                        refers = number(head["warc-refers-to"]) if "warc-refers-to" in head else None
                        whole = payload if head["warc-type"] == "response" else None
                        length = int(http["content-length"])
                        page = number(head["warc-record-id"])
                        rows.append((page, head["warc-target-uri"], length, digest, head["warc-type"], refers, whole))
                        seen, held = seen + 1, held + len(payload)
                        if held > 8 << 20 or len(rows) >= 1000:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{path} holds {seen} records instead of {expected}")
                yield _batch(rows, schema)

    # A task per archive: dealt by size, the short rows of the manifest would all meet in one task.
    files = manifest.select("path", "records").repartition(max(1, manifest.count()))
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return files.mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    manifest = write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read(manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to")
    )


ORACLE4 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest,
         max(page_id) OVER (PARTITION BY b) AS latest FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND latest <> page_id THEN latest END AS refers_to
FROM d
"""
