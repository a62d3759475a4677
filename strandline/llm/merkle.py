"""A Merkle manifest of a dataset: a tree of digests per group, a tree over the groups, and a proof for each row.

Leaves are small rows (group, order, digest) and are checkpointed; texts are read once and never shuffled. Then:

1. The leaves are range-sorted by group, order and digest. Each partition tells how many leaves its first and its last group have in
   it, one row a partition; from these counts follows at which place of its group a partition begins, and whether a group goes on.
2. Each partition builds the complete aligned subtrees of its leaves, up to FAN ** LOCAL leaves each; a subtree is one row with its
   leaves. What no partition can complete alone is at most some FAN nodes a level at either end of it.
3. These nodes, and the roots of the largest subtrees, are shuffled by the coordinate (group, level, place of the parent); runs of at most FAN
   become parents, level by level. The last ones are the groups' roots, which go through the same steps as the leaves of one more group.
4. Proofs come down the same levels and meet each subtree once, by its coordinate; its leaves take them from there.

No step gathers a group: the largest unit is a subtree of FAN ** LOCAL leaves. The driver sees one row a partition.

Defined cases: null fields are `-`; the null group comes first; null ids come first in their group; rows that repeat an id follow each
other by their digest, each with its own leaf and proof; a lone leaf is its group's root, and a lone group's root is the root, with
an empty proof; an empty table gives an empty result; texts of any length are one leaf; other columns are ignored, whatever their names.
Rows with a null doc_id are never tampered with.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

FAN, LOCAL = 16, 3
#: Leaves that a task sorts.
TASK_LEAVES = 500_000
#: Leaves whose proofs a task holds at once.
HELD = 500


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value with the number of its bytes before it, or `-`."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


# -- subtrees of a partition --------------------------------------------------------------------


def grow(leaves: list[str], first: int, ends: bool, local: int = LOCAL) -> list[tuple[int, int, str, int, int]]:
    """(level, place, digest, from, to) of the largest complete subtrees over consecutive leaves of a group.

    The leaves are at the places from `first` on, all under one node of level `local`; `ends` tells that the group ends
    with them, so that its last run is complete however short. from and to are places of leaves.
    """
    out, nodes, s, level = [], leaves, first, 0
    end = first + len(leaves)

    def emit(a: int, b: int) -> None:
        span = FAN**level
        out.extend((level, i, nodes[i - s], i * span, min((i + 1) * span, end)) for i in range(a, b))

    while nodes:
        e = s + len(nodes)
        a, b = -(-s // FAN) * FAN, e if ends else e // FAN * FAN
        if level == local or a >= b or (ends and s == 0 and e == 1):
            emit(s, e)
            break
        emit(s, a)
        emit(b, e)
        nodes = [digest("".join(nodes[i - s : min(i + FAN, b) - s])) for i in range(a, b, FAN)]
        s, level = a // FAN, level + 1
    return out


LEAVES = "g string, id long, name string, d binary, x binary"
TREES = "g string, level int, place long, digest string, ids array<long>, names array<string>, leaves binary, extra array<binary>"
_TREES = pa.schema(
    [
        ("g", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("ids", pa.list_(pa.int64())),
        ("names", pa.list_(pa.string())), ("leaves", pa.binary()), ("extra", pa.list_(pa.binary())),
    ]
)


def _ends(rows: DataFrame) -> dict[int, tuple[int, bool]]:
    """By partition, the place of its first leaf in its group, and whether its last group goes on in another partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, n, head = None, None, None, 0, 0
        for batch in batches:
            for p, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part is None:
                    part, first, last = p, g, g
                if g != last:
                    head = head or n
                    last, n = g, 0
                n += 1
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "a": [first], "b": [last], "na": [head or n], "nb": [n]})

    told = rows.select("part", "g").mapInArrow(run, "part int, a string, b string, na long, nb long")
    out: dict[int, tuple[int, bool]] = {}
    group, size, before = None, 0, None
    for r in sorted(told.collect(), key=lambda r: r.part):
        goes_on = r.a == group
        if before is not None and goes_on:
            out[before] = (out[before][0], True)
        place = size if goes_on else 0
        out[r.part] = (place, False)
        group, size, before = r.b, place + r.na if r.a == r.b else r.nb, r.part
    return out


def trees(leaves: DataFrame, local: int = LOCAL, task_leaves: int = TASK_LEAVES) -> DataFrame:
    """The complete subtrees (TREES) of checkpointed LEAVES, whose groups are not null."""
    n = leaves.count()
    tasks = max(leaves.sparkSession.sparkContext.defaultParallelism if n > 10_000 else 1, -(-n // task_leaves))
    order = ("g", "id", "name", "d")
    rows = leaves.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id()).checkpoint()
    places = _ends(rows)
    span = FAN**local

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, place, goes_on, held = None, 0, False, []

        def out(ends: bool) -> pa.RecordBatch:
            ids, names, d, x = zip(*held)
            made = []
            for level, at, top, a, b in grow([i.hex() for i in d], place, ends, local):
                cut = slice(a - place, b - place)
                made.append((group, level, at, top, ids[cut], names[cut], b"".join(d[cut]), x[cut]))
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), _TREES)], schema=_TREES)

        for batch in batches:
            for part, g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group is None:
                    group, (place, goes_on) = g, places[part]
                if held and (g != group or (place + len(held)) % span == 0):
                    yield out(g != group)
                    place, held = place + len(held), []
                if g != group:
                    group, place = g, 0
                held.append(row)
        if held:
            yield out(not goes_on)

    return rows.select("part", "g", "id", "name", "d", "x").mapInArrow(run, TREES).checkpoint()


# -- levels across partitions -------------------------------------------------------------------


def _height(n: Column) -> Column:
    """Levels above n leaves."""
    powers = F.array(*[F.lit(FAN**k) for k in range(15)])
    return F.size(F.filter(powers, lambda p: p < n))


def levels(made: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level, roots): runs (g, j, kids, digest, height), the parent's place and its children; roots (g, height, digest)."""
    nodes = made.select("g", "level", "place", "digest", (F.octet_length("leaves") / 32).cast("long").alias("n"))
    heights = nodes.groupBy("g").agg(_height(F.sum("n")).alias("height"))
    nodes = nodes.drop("n").join(heights, "g").checkpoint()
    most = nodes.agg(F.max("height")).first()[0] or 0
    runs, parents = [], nodes.where("false")
    done = [nodes.where("level = height")]
    for level in range(most):
        own = nodes.where((F.col("level") == level) & (F.col("height") > level)).unionByName(parents.where(F.col("height") > level))
        kids = F.sort_array(F.collect_list(F.struct("place", "digest")))
        run = own.groupBy("g", "height", F.floor(F.col("place") / FAN).alias("j")).agg(F.transform(kids, lambda k: k["digest"]).alias("kids"))
        run = run.withColumn("digest", F.sha2(F.array_join("kids", ""), 256)).checkpoint()
        runs.append(run)
        parents = run.select("g", F.lit(level + 1).alias("level"), F.col("j").alias("place"), "digest", "height")
        done.append(parents.where("level = height"))
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return runs, roots.select("g", "height", "digest").checkpoint()


PATH = "array<struct<left string, right string>>"


def descend(runs: list[DataFrame], heads: DataFrame) -> DataFrame:
    """(g, level, place, path, root, top): for each node of the runs and each root, the siblings on its way to the root of all.

    `heads` (g, height, path, root, top) are the groups' roots with the siblings beyond them.
    """
    found, above = [], None
    for level in range(len(runs), -1, -1):
        at = heads.where(F.col("height") == level).select("g", F.lit(0).cast("long").alias("place"), "path", "root", "top")
        if above is not None:
            at = at.unionByName(above)
        at = at.checkpoint()
        found.append(at.withColumn("level", F.lit(level)))
        if level:
            run = runs[level - 1].select("g", F.col("j").alias("place"), "kids").join(at, ["g", "place"])
            kid = run.select("g", "place", "kids", "path", "root", "top", F.posexplode("kids").alias("i", "_kid"))
            left = F.array_join(F.slice("kids", F.lit(1), F.col("i")), "")
            right = F.array_join(F.slice("kids", F.col("i") + 2, F.lit(FAN)), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            above = kid.select("g", (F.col("place") * FAN + F.col("i")).alias("place"), F.concat(step, "path").alias("path"), "root", "top")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _steps(nodes: list[str], level: int) -> list[list[tuple[str, str]]]:
    """By leaf of a complete subtree, the siblings left and right of its way up to the subtree's root."""
    out: list[list[tuple[str, str]]] = [[] for _ in nodes]
    for k in range(level):
        beside = []
        for i in range(0, len(nodes), FAN):
            run = nodes[i : i + FAN]
            beside += [("".join(run[:j]), "".join(run[j + 1 :])) for j in range(len(run))]
        for i, steps in enumerate(out):
            steps.append(beside[i // FAN**k])
        nodes = [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
    return out


PROOFS = f"g string, id long, name string, leaf string, extra string, path {PATH}, root string, top string"


def proofs(made: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a leaf (PROOFS): its digest, its path to the root of all, its group's root and the root of all."""
    names = ["g", "id", "name", "leaf", "extra", "path", "root", "top"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        *plain, path, root, top = zip(*rows)
        steps = [s for p in path for s in p]
        offsets = [0]
        for p in path:
            offsets.append(offsets[-1] + len(p))
        sides = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], pa.string()) for i in (0, 1)], ["left", "right"])
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 3]
        columns = [pa.array(list(c), k) for c, k in zip(plain, kinds)] + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sides)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(root), pa.string()), pa.array(list(top), pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, level, ids, named, leaves, extra, path, root, top in zip(*(c.to_pylist() for c in batch.columns)):
                own = [leaves[i : i + 32].hex() for i in range(0, len(leaves), 32)]
                beyond = [(p["left"], p["right"]) for p in path]
                held = []
                for i, n, d, x, steps in zip(ids, named, own, extra, _steps(own, level)):
                    held.append((g, i, n, d, None if x is None else x.hex(), steps + beyond, root, top))
                    if len(held) == HELD:
                        yield out(held)
                        held = []
                if held:
                    yield out(held)

    columns = ("g", "level", "ids", "names", "leaves", "extra", "path", "root", "top")
    return made.join(paths, ["g", "level", "place"]).select(*columns).mapInArrow(run, PROOFS)


def manifest(rows: DataFrame, group: Column, id_: Column, value: Column, extra: Column | None = None, local: int = LOCAL) -> DataFrame:
    """PROOFS of all rows: a leaf `value` (hex digest) a row, trees per `group` by `id_`, and one over the groups.

    `name` is the group; `extra` is a further hex digest that is carried along.
    """
    prepare(rows.sparkSession)
    # Groups as strings that are never null and sort the same way: null first.
    g = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    x = F.unhex(extra) if extra is not None else F.lit(None).cast("binary")
    own = rows.select(g.alias("g"), id_.cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.unhex(value).alias("d"), x.alias("x"))
    made = trees(own.checkpoint(), local)
    runs, roots = levels(made)
    groups = roots.select(
        F.lit("").alias("g"), F.lit(None).cast("long").alias("id"), F.col("g").alias("name"), F.unhex("digest").alias("d"), F.lit(None).cast("binary").alias("x")
    )
    over = trees(groups.checkpoint(), local)
    over_runs, over_roots = levels(over)
    none = F.array().cast(PATH)
    heads = over_roots.select("g", "height", none.alias("path"), F.col("digest").alias("root"), F.col("digest").alias("top"))
    beyond = proofs(over, descend(over_runs, heads)).select(F.col("name").alias("g"), "path", "top").checkpoint()
    heads = roots.select("g", "height", F.col("digest").alias("root")).join(beyond, "g").select("g", "height", "path", "root", "top")
    name = F.when(F.col("g") != "", F.substr("g", F.lit(2)))
    return proofs(made, descend(runs, heads)).withColumn("name", name).drop("g")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    other = F.when(tampered, leaf(doc_id, source, lang, n_chars, lower))
    proven = manifest(docs, source, doc_id, leaf(doc_id, source, lang, n_chars, text), other)
    out = proven.select(
        F.col("id").alias("doc_id"),
        "leaf",
        F.col("root").alias("subroot"),
        F.col("top").alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("extra", "leaf")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_BIT = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"


def _tree(name: str, leaves: str) -> str:
    """Nodes of the trees over `leaves` (g, i, d, n) with the siblings beside them, and the leaves' ways up."""
    return f"""
{name}_up AS (
  SELECT g, 0 AS level, i, d, n FROM {leaves}
  UNION ALL
  SELECT g, level + 1, i // {FAN}, sha256(string_agg(d, '' ORDER BY i)), (n + {FAN - 1}) // {FAN} FROM {name}_up WHERE n > 1
  GROUP BY g, level, i // {FAN}, n
), {name}_side AS (
  SELECT g, level, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_up WHERE n > 1 WINDOW w AS (PARTITION BY g, level, i // {FAN} ORDER BY i)
)"""


ORACLE13 = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
         sha256({_LEAF} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS other,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_BIT}))) AS crc
  FROM documents
), placed AS (
  SELECT rid, doc_id, leaf, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS start, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM docs
), own AS (SELECT g, i, leaf AS d, n FROM placed),
{_tree('a', 'own')}, roots AS (SELECT g, d FROM a_up WHERE n = 1),
subs AS (SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM roots),
{_tree('b', 'subs')}, top AS (SELECT d FROM b_up WHERE n = 1),
steps AS (
  SELECT rid, s.level, s.l, s.r FROM placed p JOIN a_side s ON s.g = p.g AND s.i = p.i // CAST({FAN} ** s.level AS BIGINT)
  UNION ALL
  SELECT rid, 100 + s.level, s.l, s.r FROM placed p JOIN b_side s ON s.i = p.g // CAST({FAN} ** s.level AS BIGINT)
), ranked AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS k, l, r FROM steps
), ways AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof, max(k) AS most FROM ranked GROUP BY rid),
fold AS (
  SELECT rid, 0 AS k, start AS d FROM placed
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(s.l || f.d || s.r) FROM fold f JOIN ranked s ON s.rid = f.rid AND s.k = f.k + 1
)
SELECT p.doc_id, p.leaf, roots.d AS subroot, top.d AS root, coalesce(w.proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = top.d AS verified
FROM placed p JOIN roots ON roots.g = p.g JOIN top ON true LEFT JOIN ways w ON w.rid = p.rid JOIN fold f ON f.rid = p.rid AND f.k = coalesce(w.most, 0)
"""
