"""Product codes of vectors by delta-maintained Lloyd iterations in whole numbers.

A component x becomes floor(4096 x); a vector is cut into `PARTS` equal parts, each with a codebook of `ENTRIES` entries.
The whole-number vectors are packed into blocks of rows and written once, bucketed by block. Each round reads the blocks
beside the assignments of the round before, which are bucketed in the same way, so that the join moves nothing; it writes the new
assignments and, of the parts whose assignment changed, what they add to one entry's running sum and take from another's. Only these
contributions, added up in each task, are shuffled: at most parts x entries x (width + 1) numbers a task. The codebook, of that size
too, is all that the driver holds. Running sums, counts and entries of each round are kept in the folder beside the assignments.

Defined cases: vectors that are null or empty, or hold null or non-finite components, are dropped, and so are those of another
length than the first one has (of the smallest vec_id); a length that the parts do not divide is filled up with zeros;
whole numbers beyond +-2^25 (components beyond +-8192) are set to that bound, so that no distance leaves 64 bits; rows that
repeat a vec_id are rows of their own, in the order of their components where the first entries are drawn; a null vec_id comes after
all others there; with fewer rows than entries the codebooks are as short; null labels are one label; sums of errors beyond 64 bits
are null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_dir, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST = 1 << 25
#: Vectors of a block, and bytes of blocks in a bucket.
BLOCK, BUCKET_BYTES = 512, 64 << 20
#: Labels up to this number, at most some 60 MB, go to all tasks with their sums; more meet the rows in a shuffle.
BROADCAST_LABELS = 1_000_000


# -- whole-number vectors -----------------------------------------------------------------------


def whole(vectors: DataFrame, column: str = "embedding", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v): kept vectors as little-endian 32-bit whole numbers."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            start = np.cumsum(size) - size
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero((size > 0) & (bad[start + size] == bad[start]))
            with np.errstate(invalid="ignore", over="ignore"):
                ints = np.clip(np.floor(SCALE * values), -MOST, MOST)
            ints = np.where(np.isfinite(values), ints, 0).astype("<i4")
            pad = [b"\0" * (4 * (-n % parts)) for n in size[good].tolist()]
            data = [ints[a : a + n].tobytes() + p for a, n, p in zip(start[good].tolist(), size[good].tolist(), pad)]
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(data, pa.binary())], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col(column).cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, label string, v binary")


def first_rows(rows: DataFrame, n: int = ENTRIES) -> np.ndarray:
    """The vectors of the smallest ids, all as long as the first."""
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(n).collect()
    if found and len({len(r.v) for r in found}) > 1:
        same = rows.where(F.octet_length("v") == len(found[0].v))
        found = same.orderBy(F.asc_nulls_last("vec_id"), "v").limit(n).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in found], np.int64)


BLOCKS = "block long, ids array<long>, labels array<string>, v binary, width int"


def blocks_of(rows: DataFrame, dim: int) -> DataFrame:
    """Vectors of `dim` numbers in blocks; 16 bits a number where a block's numbers fit."""

    def pack(number: int, held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        v = np.frombuffer(b"".join(t.column(2).to_pylist()), "<i4")
        width = 2 if not len(v) or np.abs(v).max() < 1 << 15 else 4
        data = [[number], [t.column(0).to_pylist()], [t.column(1).to_pylist()], [v.astype(f"<i{width}").tobytes()], [width]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            whole_ = pa.Table.from_batches([batch])
            while len(whole_):
                part = whole_.slice(0, BLOCK - n)
                whole_ = whole_.slice(len(part))
                held.append(part)
                n += len(part)
                if n == BLOCK:
                    yield pack(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield pack(number, held)

    return rows.where(F.octet_length("v") == 4 * dim).mapInArrow(run, BLOCKS)


# -- a round ------------------------------------------------------------------------------------


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of each row, the lower one of equally near ones; exact."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    # Doubles are exact, and faster, while no sum leaves 53 bits.
    kind = np.float64 if 3 * int(most) ** 2 * x.shape[1] < 1 << 53 else np.int64
    e = entries.astype(kind)
    return ((e * e).sum(1)[None, :] - 2 * (x.astype(kind) @ e.T)).argmin(1)


def _numbers(data: bytes, width: int, parts: int, n: int) -> np.ndarray:
    """(part, row, place) of a block's numbers."""
    return np.frombuffer(data, f"<i{width}").reshape(n, parts, -1).transpose(1, 0, 2).astype(np.int64)


def contributions(x: np.ndarray, before: np.ndarray | None, now: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) that the rows of a part whose assignment changed add to their new entry and take from their old one."""
    counts, sums = np.zeros(entries, np.int64), np.zeros((entries, x.shape[1]), np.int64)
    moved = np.arange(len(x)) if before is None else np.flatnonzero(before != now)
    for sign, at in ((1, now), (-1, before)):
        if at is not None:
            np.add.at(counts, at[moved], sign)
            np.add.at(sums, at[moved], sign * x[moved])
    return counts, sums


DELTA = "array<struct<part int, entry int, n long, sums array<long>>>"
CODES = f"block long, codes binary, delta {DELTA}"
_DELTA = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _round(codebook: np.ndarray, first: bool):
    """New assignments of blocks and what changed; input (block, v, width, n) and, but for the first round, codes."""
    parts, entries = codebook.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, v, width, n, *codes in zip(*(c.to_pylist() for c in batch.columns)):
                x = _numbers(v, width, parts, n)
                before = None if first else np.frombuffer(codes[0], np.uint8).reshape(n, parts)
                now, delta = np.empty((n, parts), np.uint8), []
                for p in range(parts):
                    now[:, p] = nearest(x[p], codebook[p])
                    count, sums = contributions(x[p], None if first else before[:, p], now[:, p], entries)
                    for e in np.flatnonzero(count.astype(bool) | sums.any(1)).tolist():
                        delta.append({"part": p, "entry": e, "n": int(count[e]), "sums": sums[e].tolist()})
                rows.append((block, now.tobytes(), delta))
            columns = list(zip(*rows)) if rows else [[]] * 3
            kinds = (pa.int64(), pa.binary(), _DELTA)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["block", "codes", "delta"])

    return run


class Lloyd:
    """Codebooks of the parts of all vectors of a table, and the codes by them.

    `codebook` is (part, entry, place); `counts` and `sums` are the running ones, per part and entry.
    """

    def __init__(
        self, vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, folder: str | None = None
    ):
        self.spark = prepare(vectors.sparkSession)
        self.folder = folder or f"{shared_dir(self.spark)}/lloyd-{uuid.uuid4().hex}"
        self.name = f"lloyd_{uuid.uuid4().hex}"
        self.parts, self.made = parts, 0
        rows = whole(vectors, column, parts)
        heads = first_rows(rows, entries)
        self.empty = not len(heads)
        if self.empty:
            return
        self.codebook = heads.reshape(len(heads), parts, -1).transpose(1, 0, 2)
        self.entries = len(heads)
        self.counts = [[0] * self.entries for _ in range(parts)]
        self.sums = [[[0] * self.codebook.shape[2] for _ in range(self.entries)] for _ in range(parts)]
        # Blocks are made once: a lost task must not put other rows into them.
        blocks = blocks_of(rows, heads.shape[1]).checkpoint()
        size = blocks.agg(F.sum(F.octet_length("v"))).first()[0]
        self.buckets = max(self.spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
        self._keep(blocks.repartition(self.buckets, "block"), "blocks")

    def _keep(self, rows: DataFrame, name: str) -> None:
        where = rows.write.bucketBy(self.buckets, "block").option("path", f"{self.folder}/{name}")
        where.format("parquet").saveAsTable(f"{self.name}_{name}")

    def blocks(self) -> DataFrame:
        return self.spark.table(f"{self.name}_blocks")

    def assignments(self, number: int) -> DataFrame:
        """(block, codes, delta) of a round, from 1."""
        return self.spark.table(f"{self.name}_codes{number}")

    def round(self) -> None:
        """Assign every part, then move the entries to the means of their parts."""
        rows = self.blocks().select("block", "v", "width", F.size("ids").alias("n"))
        first = not self.made
        if not first:
            rows = rows.join(self.assignments(self.made).select("block", "codes").hint("shuffle_hash"), "block")
        self.made += 1
        self._keep(rows.mapInArrow(_round(self.codebook, first), CODES), f"codes{self.made}")
        changed = self.assignments(self.made).select(F.explode("delta").alias("d")).select("d.part", "d.entry", "d.n", F.posexplode("d.sums"))
        added = changed.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
        codebook = self.codebook.copy()
        for r in added.collect():
            self.sums[r.part][r.entry][r.pos] += r.s
            if not r.pos:
                self.counts[r.part][r.entry] += r.n
        state = []
        for p in range(self.parts):
            for e in range(self.entries):
                if n := self.counts[p][e]:
                    codebook[p, e] = [s // n for s in self.sums[p][e]]
                state.append((p, e, self.counts[p][e], self.sums[p][e], codebook[p, e].tolist()))
        self.codebook = codebook
        kept = self.spark.createDataFrame(state, "part int, entry int, n long, sums array<long>, value array<long>")
        kept.coalesce(1).write.parquet(f"{self.folder}/state/round={self.made}")

    def digest(self) -> str:
        """SHA-256 of all entries' numbers by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.codebook.ravel().tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """(vec_id, label, code, error) by the entries as they are now."""
        codebook, parts = (None, self.parts) if self.empty else (self.codebook, self.parts)
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
        ddl = "vec_id long, label string, code string, error long"
        if self.empty:
            return self.spark.createDataFrame([], ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, v, width in zip(*(c.to_pylist() for c in batch.columns)):
                    x = _numbers(v, width, parts, len(ids))
                    code, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                    for p in range(parts):
                        code[:, p] = nearest(x[p], codebook[p])
                        error += ((x[p] - codebook[p][code[:, p]]) ** 2).sum(1)
                    shown = [c.tobytes().hex() for c in code]
                    data = (ids, labels, shown, error)
                    yield pa.RecordBatch.from_arrays([pa.array(d, f.type) for d, f in zip(data, schema)], schema=schema)

        return self.blocks().select("ids", "labels", "v", "width").mapInArrow(run, ddl)


def with_label_error(codes: DataFrame) -> DataFrame:
    """Codes with the error summed over their label."""
    kept = codes.checkpoint()
    sums = kept.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    sums = sums.checkpoint()
    small = sums.count() <= BROADCAST_LABELS
    return kept.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Lloyd(table(spark, sf_dir, "embeddings"))
    digest = ""
    if not model.empty:
        for _ in range(ROUNDS):
            model.round()
        digest = model.digest()
    coded = with_label_error(model.codes())
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: a step of assignment and one of means for each round."""
    near = """
  SELECT rid, part, v, entry, d FROM (
    SELECT rid, p.part, p.v, entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS d
    FROM parts p JOIN {0} c ON c.part = p.part
  ) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(f'c{r}')})")
        steps.append(f"""m{r} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT part, entry, i, CAST(sum(v[i]) // count(*) - CASE WHEN sum(v[i]) < 0 AND sum(v[i]) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS m
    FROM a{r}, UNNEST(range(1, len(v) + 1)) AS u(i) GROUP BY part, entry, i
  ) GROUP BY part, entry
), c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry
)""")
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
         list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), parts AS MATERIALIZED (
  SELECT rid, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM x, range(0, {PARTS}) AS r(p)
), c0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= {ENTRIES}
), {', '.join(steps)}, last AS MATERIALIZED ({near.format(f'c{rounds}')}
), coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY rid
), books AS (
  SELECT sha256(string_agg(CAST(v[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM c{rounds}, UNNEST(range(1, len(v) + 1)) AS u(i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM x JOIN coded USING (rid), books
"""
