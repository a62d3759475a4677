"""Substring de-duplication with a log-structured index of window fingerprints.

A window is `width` consecutive words. Its fingerprint and its check are polynomials of two independent halves of a cryptographic
hash of each word; the fingerprint is cut to a width that follows the corpus (`key_bits`). An equal fingerprint alone removes
nothing: the check must be equal too. An `Index` is a folder of immutable runs, each sorted by fingerprint and split into
shards by ranges of fingerprints, and a manifest of the runs that count. A batch of documents goes through it so:

1. The documents are packed into compressed blocks, which are written once, bucketed by block: every later pass sees the
   same blocks, and no pass moves texts.
2. Each block gives one sorted run per shard: distinct fingerprints with their checks and the smallest doc_id of each.
   A window that a third of all documents share is a few bytes in each run.
3. The runs of a shard are put together and merge-joined with the shard's runs of history, which are read segment by segment where they
   are and never shuffled. Fingerprint and check must both be equal. Each run gets one bit per entry back: history has
   it, or another run has it with a smaller doc_id. What is new to history becomes a run of the index.
4. Blocks mark the words of each window that starts in history or in a document with a smaller doc_id.

The run and its bits are one Parquet folder, written before the manifest names it: a batch that fails
leaves no trace in the index. A manifest is created exclusively, so of two writers the later one fails instead of losing a run. A
new process finds the index by its folder. Where `tier` runs of one level have come together, they are merged into one of the next, segment by
segment, so each entry is written again once a level; `compact` merges all runs into one.

The number of shards is fixed for an index; `dedup` takes it from the number of words, so a shard's runs stay near
`shard_windows`. `dedup` of a whole table sends it through an index of its own in `batches` batches, by ranges of doc_id
from the smallest on, so history is just the documents of smaller doc_id; the rows are the same for any number of them. All batches are
appended, and the runs of the first ones are merged on the way.

Defined cases: null text has no words; texts shorter than a window lose nothing; null doc_id counts as
larger than every other, so it is never a source for other documents of its batch; rows that repeat a doc_id are not
smaller than each other and leave each other whole; copies within one document are kept; texts of any
length are one unit; an empty table gives an empty result; other columns are ignored. For an index all of history
comes before a batch, whatever the doc_ids.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import Folder
from .common import free_name, prepare, shared_dir, table, text_bytes

WIDTH, BATCHES = 13, 3
#: Runs of a level that are merged into one of the next: of an index, and of a table's own.
TIER, OWN_TIER = 4, 2
#: Entries of a run that are read or written at once.
SEGMENT = 1 << 16
#: Words whose hashes a worker remembers, and their longest.
REMEMBERED, LONGEST = 200_000, 32
BATCH_TEXT = 8 << 20
SHARD_WINDOWS = 2_000_000
NO_ID = np.iinfo(np.int64).max
#: Bytes of text whose words are hashed at once; bounds a task's memory.
HASHED = 1 << 20


# -- blocks of documents ------------------------------------------------------------------------


def _pack(ids: list, texts: list[bytes]) -> bytes:
    import zstandard

    known = [NO_ID if i is None else i for i in ids]
    head = struct.pack("<I", len(ids)) + np.array(known, "<i8").tobytes() + np.array(list(map(len, texts)), "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    ids, sizes = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<i8", n, 4 + 8 * n)
    end = np.cumsum(sizes) + 4 + 16 * n
    return ids, [raw[a:b] for a, b in zip((end - sizes).tolist(), end.tolist())]


def _blocks(docs: DataFrame, step: str) -> DataFrame:
    """(step, batch, words, data): documents (doc_id, text) of each step in compressed blocks of about BATCH_TEXT bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held = 0, {}

        def out(of: int) -> pa.RecordBatch:
            nonlocal made
            ids, texts, _ = held.pop(of)
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            words = sum(len(t.split()) for t in texts)
            return pa.RecordBatch.from_pydict(
                {"step": pa.array([of], pa.int32()), "batch": [number], "words": [words], "data": [_pack(ids, texts)]}
            )

        for batch in batches:
            for doc_id, text, of in zip(*(c.to_pylist() for c in batch.columns)):
                if of in held and held[of][2] + len(text) > BATCH_TEXT:
                    yield out(of)
                own = held.setdefault(of, [[], [], 0])
                own[0].append(doc_id)
                own[1].append(text)
                own[2] += len(text)
        for of in sorted(held):
            yield out(of)

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes(), F.col(step).cast("int"))
    return rows.mapInArrow(run, "step int, batch long, words long, data binary")


class Blocks:
    """Blocks that are written once, bucketed by their number, so that passes by block move none of them."""

    def __init__(self, docs: DataFrame, folder: str, step: str | None = None):
        self.spark, self.name = prepare(docs.sparkSession), f"blocks_{uuid.uuid4().hex}"
        if step is None:
            step = free_name(docs, "step")
            docs = docs.withColumn(step, F.lit(0))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        made = _blocks(docs, step).write.bucketBy(buckets, "batch").option("path", f"{folder}/{self.name}")
        made.format("parquet").saveAsTable(self.name)

    def of(self, step: int | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        return rows if step is None else rows.where(F.col("step") == step)

    def words(self) -> int:
        return self.of().agg(F.sum("words")).first()[0] or 0


# -- windows ------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_random = np.random.default_rng(13)  # the same numbers everywhere
#: Odd factors of the polynomials over words and of the mixing.
_P, _MIX = _random.integers(0, 1 << 63, 2, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_known: dict[bytes, bytes] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(words: list[bytes]) -> bytes:
    """16 bytes of a cryptographic hash of each word; a worker remembers those of short words it met first."""
    out = []
    for w in words:
        h = _known.get(w)
        if h is None:
            h = hashlib.blake2b(w, digest_size=16).digest()
            if len(_known) < REMEMBERED and len(w) <= LONGEST:
                _known[w] = h
        out.append(h)
    return b"".join(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word of a text begins, and two independent hashes of it). Each distinct word is hashed once."""
    buf = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[buf]
    start = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)) == 1)
    words = data.split()  # on bytes: space and 0x09-0x0D
    distinct = list(set(words))
    place = {w: i for i, w in enumerate(distinct)}
    hashes = np.frombuffer(_hashes(distinct), "<u8").reshape(-1, 2)
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    return start, hashes[at, 0], hashes[at, 1]


class Windows:
    """The windows of a block in document order: fingerprints, checks, and where they are."""

    def __init__(self, texts: list[bytes], width: int, bits: int):
        firsts, seconds, counts = [], [], []
        part, size = [], 0
        for text in [*texts, None]:
            if part and (text is None or size + len(text) > HASHED):
                start, first, second = word_hashes(b" ".join(part))
                edges = np.cumsum([0] + [len(t) + 1 for t in part])
                counts.append(np.diff(np.searchsorted(start, edges)))
                firsts.append(first)
                seconds.append(second)
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        none = np.zeros(0, np.uint64)
        first, second = np.concatenate([none, *firsts]), np.concatenate([none, *seconds])
        self.n = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
        start = np.cumsum(self.n) - self.n
        count = np.maximum(self.n - width + 1, 0)
        self.doc = np.repeat(np.arange(len(self.n)), count)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(start, count) + self.at
        self.key = self._rolled(first, width)[place] >> np.uint64(64 - bits)
        self.check = (self._rolled(second, width)[place] >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _rolled(h: np.ndarray, width: int) -> np.ndarray:
        total = np.zeros(max(0, len(h) - width + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                total = total * _P + h[i : i + len(total)]
            return _mixed(total)


def ordered(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorting order by key and check, where each distinct pair begins in it)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    # Only among equal keys does the check count; they are few.
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(k) else np.zeros(0, np.int64)
    if len(tied):
        mine = order[tied]
        order[tied] = mine[np.lexsort((check[mine], key[mine]))]
        k = key[order]
    c = check[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    return order, np.flatnonzero(head)


def _squeeze(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys in a fixed number of bytes each; the few that need more stand apart, with their places."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0))
    costs = [(len(steps) * n + 12 * int((steps >= np.uint64(1 << 8 * n)).sum()), n) for n in range(1, 8)]
    size = min([*costs, (8 * len(steps), 8)])[1]
    far = np.flatnonzero(steps >= np.uint64(1 << 8 * size)) if size < 8 else np.zeros(0, np.int64)
    low = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    return struct.pack("<BI", size, len(far)) + far.astype("<u4").tobytes() + steps[far].astype("<u8").tobytes() + low


def _expand(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<BI", data)
    far, wide = np.frombuffer(data, "<u4", n, 5), np.frombuffer(data, "<u8", n, 5 + 4 * n)
    at = 5 + 12 * n
    raw = np.zeros(((len(data) - at) // size, 8), np.uint8)
    raw[:, :size] = np.frombuffer(data, np.uint8, offset=at).reshape(-1, size)
    steps = raw.view("<u8")[:, 0].astype(np.uint64)
    steps[far] = wide
    return np.cumsum(steps, dtype=np.uint64)


def _ids(values: np.ndarray) -> bytes:
    """doc_ids as places in the sorted list of those that occur; both compressed."""
    distinct, place = np.unique(values, return_inverse=True)
    kind = "<u2" if len(distinct) <= 1 << 16 else "<u4"
    table_ = zlib.compress(np.diff(distinct, prepend=np.int64(0)).astype("<i8").tobytes(), 1)
    return struct.pack("<BI", int(kind[2]), len(table_)) + table_ + place.astype(kind).tobytes()


def _ids_back(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<BI", data)
    distinct = np.cumsum(np.frombuffer(zlib.decompress(data[5 : 5 + n]), "<i8"))
    return distinct[np.frombuffer(data, f"<u{size}", offset=5 + n)]


# -- runs, and their merge ----------------------------------------------------------------------

RUN = "shard int, batch long, keys binary, checks binary, ids binary"
#: What a merge writes: kind 'answer' has the bits of a block's run, kind 'run' what is new to history.
TOLD = "kind string, shard int, batch long, bits binary, keys binary, checks binary"


def key_bits(words: int) -> int:
    """Width of a fingerprint: with its check of 32 bits, 20 bits more than the number of pairs has."""
    return min(62, max(38, 2 * int(words).bit_length() - 12))


def _cuts(key: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where the key ranges of the shards begin in a sorted array, and its end."""
    bounds = [(i << bits) // shards for i in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(key, np.array(bounds, np.uint64)), [len(key)]]).astype(np.int64)


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [(n.split()[0], kinds[n.split()[1]]) for n in names.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def runs_of(batches: DataFrame, shards: int, bits: int, width: int = WIDTH) -> DataFrame:
    """The runs of blocks, RUN: distinct windows in order, with the smallest doc_id of each."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for number, data in zip(batch.column("batch").to_pylist(), batch.column("data").to_pylist()):
                ids, texts = _unpack(data)
                w = Windows(texts, width, bits)
                order, head = ordered(w.key, w.check)
                first = order[head]
                key, check = w.key[first], w.check[first]
                doc = np.minimum.reduceat(ids[w.doc[order]], head) if len(head) else np.zeros(0, np.int64)
                cut, made = _cuts(key, shards, bits), []
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    a, b = cut[s], cut[s + 1]
                    made.append((s, number, _squeeze(key[a:b]), check[a:b].astype("<u4").tobytes(), _ids(doc[a:b])))
                yield _rows(made, RUN)

    return batches.mapInArrow(run, RUN)


Entries = tuple[np.ndarray, np.ndarray]


def _segments(path: str, shard: int) -> Iterator[Entries]:
    """A stored run of a shard, some entries at a time, in order."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if urlsplit(path).scheme else "file://" + path)
    files = where.get_file_info(fs.FileSelector(f"{inner}/kind=run/shard={shard}", allow_not_found=True))
    for f in sorted((f.path for f in files if f.base_name.endswith(".parquet"))):
        for batch in pq.ParquetFile(where.open_input_file(f)).iter_batches(batch_size=1, columns=["keys", "checks"]):
            for keys, checks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _expand(keys), np.frombuffer(checks, "<u4")


def _run_rows(shard: int, segments: Iterator[Entries]) -> Iterator[tuple]:
    """Rows of TOLD; `batch` counts the segments."""
    for i, (key, check) in enumerate(segments):
        yield "run", shard, i, None, _squeeze(key), check.astype("<u4").tobytes()


def _cut(key: np.ndarray, check: np.ndarray) -> Iterator[Entries]:
    return ((key[i : i + SEGMENT], check[i : i + SEGMENT]) for i in range(0, len(key), SEGMENT))


def known_to(key: np.ndarray, check: np.ndarray, history: Iterator[Entries]) -> np.ndarray:
    """Of distinct entries in order, which ones history has."""
    out = np.zeros(len(key), bool)
    for k, c in history:
        left, right = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
        # Entries with equal keys are few, each is compared.
        for d in range(int((right - left).max(initial=0))):
            at = left + d
            some = at < right
            same = at[some][check[at[some]] == c[some]]
            out[same] = True
    return out


def merge(history: list[str]):
    """Merge-join of a batch's runs of a shard with each other and with the runs of history: bits for each run, and the run of
    what is new to history."""

    def run(table_: pa.Table) -> pa.Table:
        shard = table_.column("shard")[0].as_py()
        keys = [_expand(b) for b in table_.column("keys").to_pylist()]
        sizes = list(map(len, keys))
        key = np.concatenate(keys)
        del keys
        check = np.concatenate([np.frombuffer(b, "<u4") for b in table_.column("checks").to_pylist()])
        doc = np.concatenate([_ids_back(i) for i in table_.column("ids").to_pylist()])
        order, head = ordered(key, check)
        first = order[head]
        new_key, new_check = key[first], check[first]
        known = np.zeros(len(head), bool)
        for path in history:
            known |= known_to(new_key, new_check, _segments(path, shard))
        size = np.diff(np.append(head, len(key)))
        least = np.minimum.reduceat(doc[order], head)
        earlier = np.empty(len(key), bool)
        earlier[order] = np.repeat(known, size) | (np.repeat(least, size) < doc[order])
        rows, at = [], 0
        for batch, n in zip(table_.column("batch").to_pylist(), sizes):
            rows.append(("answer", shard, batch, np.packbits(earlier[at : at + n]).tobytes(), None, None))
            at += n
        rows += _run_rows(shard, _cut(new_key[~known], new_check[~known]))
        return pa.Table.from_batches([_rows(rows, TOLD)])

    return run


def merged(runs: list[Iterator[Entries]]) -> Iterator[Entries]:
    """One run of several that have no entry in common, in order; of each run one segment is held."""
    held = [next(r, None) for r in runs]
    while any(h is not None for h in held):
        # Up to here every run is known.
        bound = min(h[0][-1] for h in held if h is not None)
        parts = []
        for i, h in enumerate(held):
            while h is not None:
                cut = int(np.searchsorted(h[0], bound, "right"))
                parts.append((h[0][:cut], h[1][:cut]))
                if cut < len(h[0]):
                    h = (h[0][cut:], h[1][cut:])
                    break
                h = next(runs[i], None)
                if h is not None and h[0][0] > bound:
                    break
            held[i] = h
        key, check = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        order = np.lexsort((check, key))
        yield from _cut(key[order], check[order])


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _flags(answers: pa.Table, cut: np.ndarray) -> np.ndarray:
    """The bits of all shards of a block, in the order of its sorted windows."""
    out = np.zeros(int(cut[-1]), bool)
    for shard, bits in zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist()):
        n = cut[shard + 1] - cut[shard]
        out[cut[shard] : cut[shard + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def finish(shards: int, bits: int, width: int, with_text: bool):
    """For cogroups of a block and its bits: the documents without the copied words."""

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for data in batch.column("data").to_pylist():
            ids, texts = _unpack(data)
            w = Windows(texts, width, bits)
            order, head = ordered(w.key, w.check)
            size = np.diff(np.append(head, len(order)))
            earlier = _flags(answers, _cuts(w.key[order[head]], shards, bits))
            copied = np.zeros(len(order), bool)
            if len(head):
                doc = ids[w.doc[order]]
                # Elsewhere before the block's own smallest doc_id, or in the block before this one.
                copied[order] = np.repeat(earlier, size) | (np.repeat(np.minimum.reduceat(doc, head), size) < doc)
            # Words of a copied window: +1 where one begins, -1 past its end, added up.
            begin = np.cumsum(w.n) - w.n
            edge = np.zeros(int(w.n.sum()) + 1, np.int64)
            at = begin[w.doc[copied]] + w.at[copied]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.append(begin, len(gone))])
            for i, (doc_id, text) in enumerate(zip(ids.tolist(), texts)):
                words = text.split()  # on bytes: space and 0x09-0x0D
                if removed[i]:
                    mine = gone[begin[i] : begin[i] + w.n[i]].tolist()
                    words = [x for x, out in zip(words, mine) if not out]
                kept = b" ".join(words)
                known = None if doc_id == NO_ID else doc_id
                shown = kept.decode(errors="replace") if with_text else None
                rows.append((known, int(w.n[i]), int(removed[i]), hashlib.sha256(kept).hexdigest(), shown))
        return pa.Table.from_batches([_rows(rows, OUT)])

    return run


# -- the index ----------------------------------------------------------------------------------

@contextmanager
def _files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are removed when they end, instead of when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Index:
    """Runs in a folder and the manifest of those that count. Runs are never changed once written.

    `parts` are the runs (path, level), the oldest first; no two have an entry in common.
    """

    def __init__(
        self, spark: SparkSession, folder: str, shards: int = 64, bits: int = 62, width: int = WIDTH, tier: int = TIER, private: bool = False
    ):
        """A new index, or the one that the folder has, with its own shards, bits and width. Runs that are merged stay for those who
        read them still, but in a `private` index."""
        self.spark, self.folder, self.tier, self.private = prepare(spark), folder, tier, private
        self.shards, self.bits, self.width = shards, bits, width
        self.generation, self.parts = 0, []
        self._manifests = Folder(spark, f"{folder}/manifest")
        names = [n for n in self._manifests.names() if n.endswith(".json")]
        if names:
            last = json.loads(self._manifests.read(names[-1]))
            self.generation, self.parts = last["generation"], [tuple(p) for p in last["parts"]]
            self.shards, self.bits, self.width = last["shards"], last["bits"], last["width"]

    def _commit(self, parts: list[tuple[str, int]]) -> None:
        row = {"generation": self.generation + 1, "shards": self.shards, "bits": self.bits, "width": self.width, "parts": parts}
        if not self._manifests.create(f"{row['generation']:012d}.json", json.dumps(row)):
            raise RuntimeError("another writer has changed the index since it was read; read it again")
        self.generation, self.parts = row["generation"], parts

    def dedup(self, docs: DataFrame, with_text: bool = False, append: bool = True) -> DataFrame:
        """OUT of new documents, against history and each other; their windows join the index if `append`."""
        return self.dedup_blocks(Blocks(docs, self.folder).of(), with_text, append)

    def dedup_blocks(self, blocks: DataFrame, with_text: bool = False, append: bool = True) -> DataFrame:
        told = runs_of(blocks, self.shards, self.bits, self.width).groupBy("shard").applyInArrow(merge([p for p, _ in self.parts]), TOLD)
        if not append:
            told = told.where("kind = 'answer'")
        path = f"{self.folder}/part-{uuid.uuid4().hex}"
        with _files_cleaned(self.spark):
            self._write(told, path)
        answers = self.spark.read.schema(TOLD).parquet(path).where("kind = 'answer'").select("shard", "batch", "bits")
        if append:
            self._commit([*self.parts, (path, 0)])
            self._level()
        by_block = blocks.select("batch", "data").groupBy("batch").cogroup(answers.groupBy("batch"))
        return by_block.applyInArrow(finish(self.shards, self.bits, self.width, with_text), OUT)

    def _write(self, told: DataFrame, path: str) -> None:
        # A run's segments stay in order.
        told.sortWithinPartitions("kind", "shard", "batch").write.partitionBy("kind", "shard").parquet(path)

    def append(self, docs: DataFrame) -> None:
        """Add the windows of new documents."""
        self.dedup(docs)

    def _level(self) -> None:
        """Merge runs while there are `tier` of one level."""
        level = 0
        while any(n >= level for _, n in self.parts):
            own = [p for p, n in self.parts if n == level]
            if len(own) >= self.tier:
                self._merge(own, level + 1)
            level += 1

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.parts) > 1:
            self._merge([p for p, _ in self.parts], 1 + max(n for _, n in self.parts))

    def _merge(self, paths: list[str], level: int) -> None:
        """Runs of a shard are read and written segment by segment, a task a shard; nothing is shuffled."""
        shards = self.spark.range(0, self.shards, 1, self.shards)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    for row in _run_rows(shard, merged([_segments(p, shard) for p in paths])):
                        yield _rows([row], TOLD)

        path = f"{self.folder}/part-{uuid.uuid4().hex}"
        self._write(shards.mapInArrow(run, TOLD), path)
        self._commit([*((p, n) for p, n in self.parts if p not in paths), (path, level)])
        if self.private:
            for p in paths:
                Folder(self.spark, p).remove("kind=run")


def dedup(
    docs: DataFrame, width: int = WIDTH, with_text: bool = False, shard_windows: int = SHARD_WINDOWS, batches: int = BATCHES
) -> DataFrame:
    """OUT of all documents of a table, with the kept text if asked for, by an index of its own."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    shares = [i / batches for i in range(1, batches)]
    bounds = (docs.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else None) or []
    bounds = sorted(set(bounds))
    # Ranges of doc_id, the smallest first; null is in the last.
    number = sum(((F.col("doc_id") > b).cast("int") for b in bounds), F.lit(0))
    number = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(number)
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    blocks = Blocks(docs.withColumn("step", number), folder, "step")
    words = blocks.words()
    shards = max(1, -(-words // shard_windows))
    index = Index(spark, folder, shards, key_bits(words), width, OWN_TIER, private=True)
    out = None
    for i in range(len(bounds) + 1):
        part = index.dedup_blocks(blocks.of(i), with_text)
        out = part if out is None else out.union(part)
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


ORACLE8 = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT rid, coalesce(doc_id, {NO_ID}) AS doc_id, i, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS g
  FROM w, UNNEST(range(1, len(ws) - {WIDTH - 2})) AS u(i)
), flag AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id
), gone AS (SELECT DISTINCT rid, i + k AS p FROM flag, range(0, {WIDTH}) AS r(k)),
words AS (SELECT rid, p, ws[p] AS word FROM w, UNNEST(range(1, len(ws) + 1)) AS u(p)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.rid = w.rid LEFT JOIN n ON n.rid = w.rid
"""
