"""Shared helpers: tables, the shared folder, shipping the package, components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import spread

#: Upper bound of the Arrow batches that Python workers get.
BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 1000

_shipped: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, make sure of a checkpoint folder and send this package to the executors.

    The checkpoint folder is the one that the cluster names in spark.checkpoint.dir; only where it is
    unset (local tests) does a temporary one take its place.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(top)
        path = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, top)))
        sc.addPyFile(path)
        _shipped[sc.applicationId] = path
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a temporary one where that is unset and all is one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if "local" not in _shipped:
        _shipped["local"] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _shipped["local"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its name; texts and pages of fewer splits than there are cores are dealt out once."""
    rows = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def free_name(docs: DataFrame, base: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{base}{i}").lower() not in taken)


#: Ids up to this number, at most some 16 MB, go to all tasks; more meet the documents in a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among `ids`; rows without an id stay. Texts move only if ids are many."""
    gone = ids.where("doc_id IS NOT NULL").distinct().checkpoint()
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    return text_or_empty(col).cast("binary")


def with_schema(like: DataFrame, extra: str = "") -> str:
    """DDL of a DataFrame's columns, and more."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    return ddl + (", " + extra if extra else "")


def arrow_rows(
    schema: pa.Schema, row: Callable[..., Iterable[tuple]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that makes output tuples of one input row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for values in zip(*(c.to_pylist() for c in batch.columns)) for out in row(*values)]
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return run


def union_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u[i] and v[i]; label[i] is the smallest member of i's set, before and after."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node; nodes without edges are absent.

    Alternating large-star and small-star rounds. Every round is checkpointed, so that neither the
    lineage nor the work lost with an executor grows with the rounds. Minima are aggregated before
    they are shuffled, and the joins are plain equi-joins, whose large keys adaptive execution splits.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
