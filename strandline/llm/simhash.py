"""SimHash near-duplicates, found with BK-trees in shards.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its word shingles.
Two fingerprints link at `radius` or fewer differing bits; documents fall into the connected
components of these links (`near_duplicates`).

How the search is sharded: the 64 bits are cut into blocks. Two fingerprints that differ in
at most `radius` bits agree wholly on at least blocks - radius of them, so every link lies inside
at least one shard keyed by the values of such a choice of blocks; the number of blocks follows the number of
fingerprints, so that shards stay near `shard_rows`. In a shard the distinct
fingerprints form a BK-tree, children keyed by their integer Hamming distance to the parent; every
fingerprint of the shard probes the tree and follows only edges within `radius` of its own distance.

A shard of more than `shard_rows` fingerprints is dealt into chunks. Each pair of chunks is one unit
with a tree of its own, so a hot shard becomes many tasks of bounded memory and its trees are
replicated to the probes that need them (a fragment-and-replicate broadcast by shuffle; fingerprints
never pass through the driver). A unit reports at most one edge for each fingerprint: the smallest
of its component within the unit.

`similar_documents`, which the pipeline uses, links documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Fingerprints alone cannot tell this: at 0.8 some 10 of 64 bits differ. So
its shards are keyed by bands of min-hashes (10 of 3, of which two texts share one at 0.8 in 99.9 %), the trees are
followed within 20 bits, and what they give is checked with the whole shingle sets, 32 bits of hash a shingle. Pairs that are
in one component already are not checked again, so a large group costs about one check a document. Shards are dealt into chunks
by the bytes of their sets as well, so that long texts need more tasks instead of more memory.

Nodes of the graph are the smallest doc_ids of equal fingerprints, or of equal shingle sets, so a component's
smallest node is its id. Defined cases: null text is empty; a text without words has fingerprint zero, which
links like any other (without words, `similar_documents` takes texts as equal); fewer words than the shingle size
make one shingle of the whole sequence; null doc_id keeps its row, and is a component's id only if all ids in it
are null; rows that repeat a doc_id are the same document, and link whatever their texts; an empty table gives an
empty result; columns other than the two used are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, prepare, text_bytes, union_labels, without_ids
from .substring import _expand, _squeeze

SHARD_ROWS = 4096
#: Pairs of a probe and a node that are looked at together; bounds a task's memory.
FRONTIER = 1 << 18
#: Of `similar_documents`: shingle size, similarity, bands, min-hashes in each, radius.
SIZE, SIMILARITY, BANDS, BAND_ROWS, RADIUS = 5, 0.8, 10, 3, 20
#: Rows with sets that a unit takes of a shard, and bytes of their sets.
SET_ROWS, SET_BYTES = 1024, 16 << 20


def shingles(data: bytes, size: int) -> np.ndarray:
    """The XXH64 values of the word shingles of UTF-8 text, repeats included."""
    import xxhash

    words = data.lower().split()  # on bytes: A-Z only, and splits at space and 0x09-0x0D only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= size:
        return np.frombuffer(digest(joined, 42), ">u8").astype(np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    start = np.concatenate([[0], end[:-1] + 1])[: n - size + 1].tolist()
    end = end[size - 1 :].tolist()
    del words
    parts = []
    for at in range(0, len(start), 16384):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(start[at : at + 16384], end[at : at + 16384])])
        parts.append(np.frombuffer(raw, ">u8").astype(np.uint64))
    return np.concatenate(parts)


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the values; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 16384):
        raw = values[at : at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes()) if len(values) else 0


def fingerprint(data: bytes, size: int = 4) -> int:
    """SimHash of UTF-8 text as an unsigned 64-bit integer."""
    return majority(shingles(data, size))


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(b, size) for b in batch.column(1).to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(
        run, "doc_id long, fp long"
    )


class BKForest:
    """BK-trees of many units at once, in arrays. Rows must be sorted by unit."""

    def __init__(self, unit: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        head = np.concatenate([[True], unit[1:] != unit[:-1]])
        first = np.flatnonzero(head)
        self.root = first[np.cumsum(head) - 1]
        at, waiting = self.root.copy(), np.flatnonzero(~head)
        keys, nodes = [], []
        while len(waiting):
            parent = at[waiting]
            key = parent * 65 + np.bitwise_count(fp[waiting] ^ fp[parent])
            distinct, index = np.unique(key, return_index=True)
            child = waiting[index]
            keys.append(distinct)
            nodes.append(child)
            at[waiting] = child[np.searchsorted(distinct, key)]
            left = np.ones(len(waiting), bool)
            left[index] = False
            waiting = waiting[left]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.edge = key[order]
        self.child = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (probe, node) within the radius, probe above node, every row probing its unit's tree."""
        n = len(self.fp)
        waiting = [(np.arange(a, min(n, a + FRONTIER)), self.root[a : a + FRONTIER]) for a in range(0, n, FRONTIER)]
        while waiting:
            probe, node = waiting.pop()
            if len(probe) > FRONTIER:
                waiting += [(probe[a : a + FRONTIER], node[a : a + FRONTIER]) for a in range(0, len(probe), FRONTIER)]
                continue
            d = np.bitwise_count(self.fp[probe] ^ self.fp[node]).astype(np.int64)
            near = (d <= radius) & (probe > node)
            if near.any():
                yield probe[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - low
            total = int(count.sum())
            if total:
                place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)
                waiting.append((np.repeat(probe, count), self.child[place]))


# Says of pairs (probe, node) of a unit's rows which are links.
Check = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _unite(label: np.ndarray, probe: np.ndarray, node: np.ndarray, check: Check | None) -> None:
    """Join the sets of linked pairs. Of each probe one pair at a time is checked, and none within a set."""
    if check is None:
        union_labels(label, probe, node)
        return
    while len(probe):
        apart = label[probe] != label[node]
        probe, node = probe[apart], node[apart]
        _, first = np.unique(probe, return_index=True)
        linked = first[check(probe[first], node[first])]
        union_labels(label, probe[linked], node[linked])
        left = np.ones(len(probe), bool)
        left[first] = False
        probe, node = probe[left], node[left]


def _forest_edges(radius: int, rows: int, checks: Callable[[pa.Table], Check] | None = None):
    """For rows (unit, fp, node, ...) in order of units: edges (a, b) of nodes."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        unit, fp = part.column("unit").to_numpy(), part.column("fp").to_numpy()
        label, check = np.arange(len(fp)), checks(part) if checks else None
        for probe, node in BKForest(unit, fp.view(np.uint64)).links(radius):
            _unite(label, probe, node, check)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        nodes = part.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(linked)), nodes.take(pa.array(label[linked]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < rows and (not checks or sum(b.nbytes for b in held) < SET_BYTES):
                continue
            whole = pa.Table.from_batches(held)
            unit = whole.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut:
                yield solve(whole[:cut])
            held, n = whole[cut:].combine_chunks().to_batches(), len(whole) - cut
        if n:
            yield solve(pa.Table.from_batches(held))

    return run


def _edges(sharded: DataFrame, radius: int, shard_rows: int, checks=None) -> DataFrame:
    """Edges (a, b) between nodes from rows (shard, fp, node, ...): hot shards are dealt into pairs of chunks."""
    more = [c for c in sharded.columns if c != "shard"]
    chunks = F.ceil(F.count("*") / shard_rows)
    if checks:
        chunks = F.greatest(chunks, F.ceil(F.sum(F.octet_length("hashes")) / SET_BYTES))
    hot = sharded.groupBy("shard").agg(chunks.cast("int").alias("chunks")).where("chunks > 1")
    dealt = sharded.join(hot, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp", "node"), F.col("chunks")).cast("int")
    unit = dealt.select("shard", *more, mine.alias("mine"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    unit = unit.select(F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), *more)
    kind = sharded.schema["node"].dataType.simpleString()
    return unit.repartition("unit").sortWithinPartitions("unit", "fp").mapInArrow(
        _forest_edges(radius, 16 * shard_rows, checks), f"a {kind}, b {kind}"
    )


def blocks_for(n: int, radius: int, shard_rows: int = SHARD_ROWS) -> int:
    """The fewest blocks whose shards hold about `shard_rows` of n evenly spread fingerprints."""
    blocks = radius + 1
    while blocks < 2 * radius and n > shard_rows << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def links(prints: DataFrame, radius: int = 4, blocks: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints whose components are those of all links.

    `prints` has `fp` and, if fingerprints are not their own nodes, `node`.
    """
    if "node" not in prints.columns:
        prints = prints.select("fp", F.col("fp").alias("node"))
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    starts = [sum(widths[:i]) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            value = F.shiftrightunsigned("fp", 64 - starts[i] - widths[i]).bitwiseAND((1 << widths[i]) - 1)
            # Hashed from the third block on, as more of them do not fit in one number.
            key = F.xxhash64(key, value)
        keys.append(key)
    return _edges(prints.select("fp", "node", F.explode(F.array(*keys)).alias("shard")), radius, shard_rows)


_NODE = "decimal(20,0)"
_PAST = 1 << 63


def _node(first_id: str, unsigned: F.Column) -> F.Column:
    """The smallest doc_id; beyond all doc_ids where there is none."""
    return F.when(F.col(first_id).isNull(), F.lit(str(_PAST)).cast(_NODE) + unsigned).otherwise(F.col(first_id).cast(_NODE)).cast(_NODE)


def _unsigned(column: str) -> F.Column:
    wide = F.col(column).cast(_NODE)
    return F.when(wide < 0, wide + F.lit(str(1 << 64)).cast(_NODE)).otherwise(wide)


def _classes(each: DataFrame, distinct: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """`each` (doc_id, key, ...) with component_id; `distinct` has (key, node), `edges` (a, b) between nodes."""
    # A doc_id whose rows differ links them all, by way of itself.
    twice = each.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x <> y")
    rows = each.join(twice.select("doc_id"), "doc_id").select("doc_id", key).distinct()
    same = rows.join(distinct.select(key, "node"), key).select(F.col("doc_id").cast(_NODE).alias("a"), F.col("node").alias("b"))
    of = components(edges.union(same))
    found = distinct.select(key, "node").join(of, "node", "left")
    root = F.coalesce("root", "node")
    found = found.select(key, F.when(root < F.lit(str(_PAST)).cast(_NODE), root).cast("long").alias("component_id"))
    return each.join(found, key)


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prepare(docs.sparkSession)
    each = fingerprints(docs, size).checkpoint()
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    distinct = distinct.select("fp", _node("first_id", _unsigned("fp")).alias("node")).checkpoint()
    edges = links(distinct, radius, blocks or blocks_for(distinct.count(), radius))
    return _classes(each, distinct, edges, "fp").select("doc_id", "fp", "component_id")


# -- similarity of shingle sets -----------------------------------------------------------------

_SETS = "doc_id long, fp long, key string, bands array<long>, n long, hashes binary"


def shingle_sets(docs: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """_SETS: key is a digest of a text's shingle set, n its size, hashes the high halves of its hashes in order, as
    differences."""
    # Odd factors, each of which gives another order of the hashes.
    odd = (np.random.default_rng(7).integers(0, 1 << 63, bands * band_rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for data in batch.column(1).to_pylist():
                values = shingles(data, size)
                own = np.unique(values)
                least = np.zeros(len(odd), np.uint64)
                for i in range(0, len(odd), 4):  # some at a time: bounded memory for long texts
                    if len(own):
                        least[i : i + 4] = (own * odd[i : i + 4, None]).min(axis=1)
                keys = [xxhash.xxh64_intdigest(least[i : i + band_rows].tobytes(), i) for i in range(0, len(odd), band_rows)]
                half = np.unique((own >> np.uint64(32)).astype("<u4"))
                row = (majority(values), xxhash.xxh3_128_hexdigest(own.tobytes()), np.array(keys, np.uint64).view(np.int64), len(half), _squeeze(half.astype(np.uint64)))
                for column, value in zip(out, row):
                    column.append(value)
            fp = pa.array(np.array(out[0], np.uint64).view(np.int64))
            rest = [pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, *rest], ["doc_id", "fp", "key", "bands", "n", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, _SETS)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, given in order."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _set_check(similarity: float):
    def checks(part: pa.Table) -> Check:
        sets = [_expand(x).astype("<u4") for x in part.column("hashes").to_pylist()]
        n = part.column("n").to_numpy()

        def check(probe: np.ndarray, node: np.ndarray) -> np.ndarray:
            low, high = np.minimum(n[probe], n[node]), np.maximum(n[probe], n[node])
            linked = low >= similarity * high
            for i in np.flatnonzero(linked).tolist():
                p, q = probe[i], node[i]
                linked[i] = not n[p] or jaccard(sets[p], sets[q]) >= similarity
            return linked

        return check

    return checks


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, key, component_id): component_id is the smallest doc_id reachable over links of similar texts."""
    prepare(docs.sparkSession)
    each = shingle_sets(docs, size, BANDS, BAND_ROWS).checkpoint()
    distinct = each.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    # Equal sets have equal bands, so any row's will do.
    past = F.conv(F.substring("key", 1, 15), 16, 10).cast(_NODE)
    distinct = distinct.select("key", "fp", "bands", _node("first_id", past).alias("node")).checkpoint()
    sharded = distinct.select("key", "fp", "node", F.explode("bands").alias("shard"))
    shared = sharded.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
    sharded = sharded.join(shared.select("shard"), "shard").checkpoint()
    # Sets move only for texts that share a band with another.
    wanted = sharded.select("key").distinct()
    sets = each.select("key", "n", "hashes").join(wanted, "key").dropDuplicates(["key"])
    edges = _edges(sharded.join(sets, "key").drop("key"), radius, SET_ROWS, _set_check(similarity))
    return _classes(each.select("doc_id", "key"), distinct, edges, "key").select("doc_id", "key", "component_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each group's document of the smallest doc_id; documents without an id stay."""
    found = similar_documents(docs)
    return without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))
