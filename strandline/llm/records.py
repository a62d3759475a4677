"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A data file is a sequence of frames: the payload's length (unsigned 64 bits), the masked CRC-32C of these eight bytes,
the payload, and the masked CRC-32C of the payload, all little-endian; readers of that public framing read it as it
is. A payload is a header of 16 bytes (doc_id, number of ids, bytes an id, whether there is a doc_id) and the ids, two bytes
each where the vocabulary has at most 65,536 of them, else four.

Documents are dealt by ranges of doc_id and sorted, so the files in the order of (part, number) hold all documents in ascending
order. Each task writes files of about `roll` bytes under names of their own, each with an index file of the
frames' offsets, sizes and ids, and reports them in a manifest; this is checkpointed before anything reads, so files of failed
attempts are never read. `read` goes through whole files and verifies frames, checksums and index; `shuffled` deals the
index entries by a seeded hash and fetches single frames in that order.

Defined cases: null and empty texts are the closing id alone; a null doc_id comes before all others and is kept;
rows that repeat a doc_id follow each other by their text; an empty table gives an empty result; a document of any
length is one record, of which a task holds one at a time beside its batch; other columns are ignored, whatever their
names; a damaged file fails the read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, shared_dir, table, text_or_empty
from .packing import VOCABULARY, encoder, vocabulary_path
from .warc import _open

CLOSING, ROLL = 1, 256 << 20
#: Bytes of text that a task sorts and encodes.
TASK_BYTES = 64 << 20
#: Bytes of payloads that are verified at once.
HELD = 2 << 20

# -- CRC-32C ------------------------------------------------------------------------------------

#: Fixed values of the checksum and of its masking.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
_SEGMENT = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_BYTE = _byte_table()


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on each byte of the argument."""
    return op[0][x & 255] ^ op[1][(x >> 8) & 255] ^ op[2][(x >> 16) & 255] ^ op[3][x >> 24]


def _zeros() -> list[np.ndarray]:
    """The maps that append 1, 2, 4, ... zero bytes."""
    x = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    ops = [_BYTE[x & 255] ^ (x >> 8)]
    for _ in range(40):
        ops.append(_apply(ops[-1], ops[-1]))
    return ops


_ZEROS = _zeros()


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message, of all at once.

    Messages, zero bytes put before them, are cut into segments; these are taken byte by byte side by side, and each
    remainder is then moved past the segments that follow it.
    """
    if not messages:
        return np.zeros(0, np.uint32)
    size = np.array(list(map(len, messages)), np.int64)
    count = np.maximum(1, -(-size // _SEGMENT))
    last = np.cumsum(count)
    buf = np.zeros(int(last[-1]) * _SEGMENT, np.uint8)
    for message, end, n in zip(messages, (last * _SEGMENT).tolist(), size.tolist()):
        buf[end - n : end] = np.frombuffer(message, np.uint8)
    state = np.zeros(int(last[-1]), np.uint32)
    for column in buf.reshape(-1, _SEGMENT).T:
        state = _BYTE[(state ^ column) & 255] ^ (state >> 8)
    follow = np.repeat(last, count) - 1 - np.arange(len(state))
    bit = 0
    while (rest := follow >> bit).any():
        some = (rest & 1).astype(bool)
        state[some] = _apply(_ZEROS[bit + _SEGMENT.bit_length() - 1], state[some])
        bit += 1
    out = np.bitwise_xor.reduceat(state, last - count)
    # The register starts with all bits set, moved past the whole message.
    start = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for bit in range(int(size.max()).bit_length()):
        some = (size >> bit & 1).astype(bool)
        start[some] = _apply(_ZEROS[bit], start[some])
    return ~(out ^ start)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


# -- frames -------------------------------------------------------------------------------------

_HEAD = struct.Struct("<qIBB2x")
_LENGTH = struct.Struct("<Q")
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("at", "<u8"), ("size", "<u8"), ("start", "<u8"), ("n", "<u8")])


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, len(ids), width, doc_id is not None) + ids.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of a payload."""
    doc_id, n, width, known = _HEAD.unpack_from(data)
    if len(data) != _HEAD.size + n * width:
        raise ValueError("a payload's length differs from its header")
    return doc_id if known else None, np.frombuffer(data, f"<u{width}", n, _HEAD.size).astype("<u4")


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [_LENGTH.pack(len(p)) for p in payloads]
    head, tail = (masked(crc32c(x)).astype("<u4") for x in (lengths, payloads))
    return [n + a.tobytes() + p + b.tobytes() for n, a, p, b in zip(lengths, head, payloads, tail)]


def verified(cut: list[bytes]) -> list[bytes]:
    """The payloads of frames whose lengths and checksums hold."""
    lengths, payloads = [f[:8] for f in cut], [f[12:-4] for f in cut]
    told = np.array([struct.unpack_from("<I", f, 8) + struct.unpack("<I", f[-4:]) for f in cut], np.uint32).reshape(-1, 2)
    if any(_LENGTH.unpack(n)[0] != len(p) for n, p in zip(lengths, payloads)):
        raise ValueError("a frame's length differs")
    if (told[:, 0] != masked(crc32c(lengths))).any() or (told[:, 1] != masked(crc32c(payloads))).any():
        raise ValueError("a frame's checksum differs")
    return payloads


class Writer:
    """One data file and its index."""

    def __init__(self, path: str):
        self.path, self.out = path, _open(f"{path}.rec", "w")
        self.entries: list[tuple] = []
        self.size = self.ids = 0

    def add(self, documents: list[tuple[int | None, np.ndarray]], width: int) -> None:
        for (doc_id, ids), frame in zip(documents, frames([payload(d, ids, width) for d, ids in documents])):
            self.out.write(frame)
            self.entries.append((doc_id or 0, doc_id is not None, self.size, len(frame), self.ids, len(ids)))
            self.size += len(frame)
            self.ids += len(ids)

    def close(self) -> tuple[str, int, int, int]:
        """(path, records, ids, bytes)."""
        self.out.close()
        raw = np.array(self.entries, ENTRY).tobytes()
        with _open(f"{self.path}.idx", "w") as index:
            index.write(frames([raw])[0])
        return self.path, len(self.entries), self.ids, self.size


def index_of(path: str) -> np.ndarray:
    with _open(f"{path}.idx", "r") as index:
        return np.frombuffer(verified([index.read()])[0], ENTRY)


# -- writing ------------------------------------------------------------------------------------

MANIFEST = "part int, number int, path string, records long, ids long, bytes long"


def write(
    docs: DataFrame, folder: str, closing: int = CLOSING, roll: int = ROLL, task_bytes: int = TASK_BYTES, path: str | None = None
) -> DataFrame:
    """Write the ids of all documents under `folder`; the checkpointed manifest, with `first`, the ids before each file."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(path or vocabulary_path(VOCABULARY))
        width = 2 if len(coder.ends) <= 1 << 16 else 4
        out, number, end = None, 0, np.array([closing], "<u4").tobytes()
        files = []

        def close():
            files.append((TaskContext.get().partitionId(), number, *out.close()))

        for batch in batches:
            ids = coder.encode(batch.column(1).to_pylist())
            documents = [(d, np.frombuffer(i + end, "<u4")) for d, i in zip(batch.column(0).to_pylist(), ids)]
            if out and out.size >= roll:
                close()
                out, number = None, number + 1
            out = out or Writer(f"{folder}/{uuid.uuid4().hex}")
            out.add(documents, width)
        if out:
            close()
        columns = list(zip(*files)) if files else [[] for _ in range(6)]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    manifest = rows.mapInArrow(run, MANIFEST).checkpoint()
    # One row a file.
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))).checkpoint()


# -- reading ------------------------------------------------------------------------------------

OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"
_KINDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]


def _rows(payloads: list[bytes], starts: list[int], with_ids: bool) -> pa.RecordBatch:
    schema = pa.schema(_KINDS if with_ids else _KINDS[:4])
    rows = []
    for data, start in zip(payloads, starts):
        doc_id, ids = unpack(data)
        raw = ids.tobytes()
        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw)[: len(schema)])
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _file(path: str, first: int, records: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of one file, read from its beginning to its end."""
    entries = index_of(path)
    if len(entries) != records:
        raise ValueError(f"the index of {path} has {len(entries)} records instead of {records}")
    cut, at, i, size = [], 0, 0, 0

    def out(last: int) -> pa.RecordBatch:
        starts = (first + entries["start"][last - len(cut) : last].astype(np.int64)).tolist()
        batch = _rows(verified(cut), starts, with_ids)
        if batch.column(0).to_pylist() != [int(e["doc_id"]) if e["known"] else None for e in entries[last - len(cut) : last]]:
            raise ValueError(f"the index of {path} names other documents")
        return batch

    with _open(f"{path}.rec", "r") as stream:
        while head := stream.read(12):
            if len(head) < 12 or i == records or entries["at"][i] != at:
                raise ValueError(f"{path} and its index differ at byte {at}")
            n = _LENGTH.unpack_from(head)[0]
            if n + 16 != entries["size"][i]:
                raise ValueError(f"a frame's length differs in {path}")
            cut.append(head + stream.read(n + 4))
            at, i, size = at + n + 16, i + 1, size + n
            if size > HELD or len(cut) >= 1000:
                yield out(i)
                cut, size = [], 0
    if i != records:
        raise ValueError(f"{path} holds {i} records instead of {records}")
    if cut:
        yield out(i)


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """OUT of all documents, and their ids as little-endian unsigned 32-bit bytes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, records in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _file(path, first, records, with_ids)

    files = manifest.select("path", "first", "records").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, OUT + ", ids binary" * with_ids)


def entries(manifest: DataFrame) -> DataFrame:
    """The index: one row a record, with its file, place and size."""
    names = ["path", "at", "size", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                found = index_of(path)
                for i in range(0, len(found), 10_000):
                    e = found[i : i + 10_000]
                    columns = [pa.array([path] * len(e)), *(pa.array(e[n].astype(np.int64)) for n in names[1:3])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(e["start"].astype(np.int64) + first)], names=names)

    files = manifest.select("path", "first").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "path string, at long, size long, start long")


def shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """OUT with ids of all documents in an order drawn by `seed`: index entries are dealt, frames are fetched singly."""
    order = F.xxhash64(F.lit(seed), "start")
    dealt = entries(manifest).withColumn("o", order).repartitionByRange("o").sortWithinPartitions("o", "start").drop("o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += row[2]
                if size > HELD:
                    yield _fetched(held)
                    held, size = [], 0
            if held:
                yield _fetched(held)

    return dealt.mapInArrow(run, OUT + ", ids binary")


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    """Frames of some files, each file opened once and read forwards, in the order asked for."""
    cut: list[bytes] = [b""] * len(rows)
    by_file: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        by_file.setdefault(row[0], []).append(i)
    for path, own in by_file.items():
        with _open(f"{path}.rec", "at") as stream:
            for i in sorted(own, key=lambda i: rows[i][1]):
                stream.seek(rows[i][1])
                cut[i] = stream.read(rows[i][2])
    return _rows(verified(cut), [r[3] for r in rows], True)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return read(write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"))
