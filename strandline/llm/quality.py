"""Quality classifier: document evidence, shrunk host and path posteriors, by hierarchical empirical Bayes.

A logistic model over style features of a whole text, fitted on labelled documents, gives each document
its evidence: the log odds of good quality beyond the labels' base rate. Grouped sums of the documents'
probabilities give every host (source) and path (source and language) a posterior mean:

    host mean = (sum of the host + k_host * global mean) / (documents of the host + k_host)
    path mean = (sum of the path + k_path * host mean)  / (documents of the path + k_path)

k_host and k_path are estimated from the spread of the means over what sampling alone would give (method
of moments), so sparse or uninformative sites shrink to the prior above them. A document's own
probability is left out of all three sums it is judged by, those of its path, its host and the corpus; a corpus of
one document has the mean 0.5. Evidence and path mean add up as log odds; a document is kept at `keep_at` or more.

The model is fitted on at most `sample` labelled documents, chosen by hash, whose feature rows (not
texts) come to the driver; everything else covers all documents.

Defined cases: null texts are empty, and an empty text is rejected only on its features; null source or
lang is a group of its own, apart from the empty string; rows that repeat a doc_id are judged each, and the first
in order of their features is that of its label; missing, null or one-sided labels give no evidence, and then all documents
are kept; a document labelled twice is good only if all its labels say so; documents of any length are
read whole; an empty table gives an empty result; other columns are ignored, and kept by `keep_good`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BROADCAST_IDS, free_name, prepare, table, text_or_empty

SAMPLE, RIDGE, KEEP_AT = 20_000, 1e-3, 0.5
#: Paths up to this number, at most some 10 MB, are broadcast.
SITE_ROWS = 50_000
N_FEATURES = 16
#: Prior strengths stay within these bounds.
LEAST_K, MOST_K = 2.0, 1e6

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_SYMBOL = [ord(c) for c in "#$%&*|!<>{}[]\\^_~=+@"]
_STOP = [ord(c) for c in ".,;:?"]


def features(text: str) -> list[float]:
    """Style of a whole text; each value is in a small fixed range."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * N_FEATURES
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    w = len(words)
    letters = int(byte[_UPPER].sum() + byte[_LOWER].sum() + byte[128:].sum())
    count = Counter(words)
    lines = text.split("\n")
    same_next = sum(map(str.__eq__, words, words[1:])) if w > 1 else 0
    ends = sum(map(lambda x: x[-1] in "#$%&*!|~^=+", count)) if w else 0
    single = count.get("|", 0)
    return [
        np.log1p(w) / 10,
        min(n / max(1, w), 40) / 40,
        letters / n,
        byte[_UPPER].sum() / max(1, letters),
        byte[_DIGIT].sum() / n,
        byte[_SYMBOL].sum() / n,
        byte[_STOP].sum() / max(1, w),
        byte[10] / max(1, w),
        len(count) / max(1, w),
        max(count.values(), default=0) / max(1, w),
        same_next / max(1, w),
        1 - len(set(lines)) / len(lines),
        ends / max(1, len(count)),
        single / max(1, w),
        len(zlib.compress(data, 1)) / n,
        min(w, 30) / 30,
    ]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, base log odds) of a logistic model, by Newton steps; no evidence from one class."""
    if not len(y) or y.min() == y.max():
        width = x.shape[1]
        return np.zeros(width), np.ones(width), np.zeros(width + 1), 0.0
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weights = np.zeros(z.shape[1])
    penalty = ridge * len(y) * np.append(np.ones(z.shape[1] - 1), 0)
    for _ in range(25):
        p = sigmoid(z @ weights)
        step = np.linalg.solve(
            (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * weights
        )
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, weights, float(np.log(y.mean() / (1 - y.mean())))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model of at most `sample` labelled documents."""
    one = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).dropna()
    one = one.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    mine = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    chosen = mine.join(F.broadcast(one), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

    # A doc_id that many rows repeat counts once, so the driver gets no more rows than the sample has.
    rows = chosen.mapInArrow(run, "doc_id long, x array<double>, y double").groupBy("doc_id").agg(F.min("x"), F.min("y"))
    got = rows.toArrow()
    x = np.array(got.column(1).to_pylist(), float).reshape(len(got), N_FEATURES)
    return fit(x, got.column(2).to_numpy())


def _group(column: str) -> F.Column:
    """A key of equal values; null is a value of its own."""
    value = F.col(column).cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))


def evidence(docs: DataFrame, model, carry: list[F.Column]) -> DataFrame:
    """The columns `carry`, the site (_host, _path), and `_log_odds`, the model's log odds, of each document."""
    mean, scale, weights, _ = model
    plain = docs.select(*carry, _group("source").alias("_host"), _group("lang").alias("_path"))
    fields = [StructField(f.name, f.dataType, True) for f in plain.schema.fields]
    schema = StructType([*fields, StructField("_log_odds", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, texts = batch.columns
            x = np.array([features(t) for t in texts.to_pylist()], float).reshape(len(texts), N_FEATURES)
            odds = (((x - mean) / scale) @ weights[:-1] + weights[-1]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(odds, pa.float64())], schema.names)

    rows = docs.select(*carry, _group("source"), _group("lang"), text_or_empty()).mapInArrow(run, schema)
    return rows.withColumn("_p", 1 / (1 + F.exp(-F.col("_log_odds"))))


def _strength(groups: DataFrame, total: str, n: str, prior: str) -> float:
    """k of a Beta prior: p (1 - p) over the spread that sampling does not explain, less 1."""
    g = groups.select(
        (F.col(total) / F.col(n)).alias("m"), F.col(n).cast("double").alias("n"), F.col(prior).alias("p")
    ).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("p"), 2)),
        F.sum("n"),
        F.count("*"),
        F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))),
    ).first()
    if not g[1]:
        return MOST_K
    inner = max(g[3] / g[1], 1e-9)
    spread = g[0] / g[1] - inner * g[2] / g[1]
    return float(min(MOST_K, max(LEAST_K, inner / spread - 1 if spread > 1e-12 else MOST_K)))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """By path: its and its host's sums and numbers, those of the corpus, the prior strengths and the host's mean `_prior`;
    and the global mean.

    `scored` has _host, _path and _p. Sums are aggregated before the shuffle, so a hot host is a few rows.
    """
    path = scored.groupBy("_host", "_path").agg(F.count("*").alias("_path_n"), F.sum("_p").alias("_path_sum")).checkpoint()
    total, n = path.agg(F.sum("_path_sum"), F.sum("_path_n")).first()
    total, n = total or 0.0, n or 0
    mean = total / n if n else 0.5
    host = path.groupBy("_host").agg(F.sum("_path_n").alias("_host_n"), F.sum("_path_sum").alias("_host_sum"))
    k_host = _strength(host.withColumn("_g", F.lit(mean)), "_host_sum", "_host_n", "_g")
    host = host.withColumn("_prior", (F.col("_host_sum") + k_host * mean) / (F.col("_host_n") + k_host))
    both = path.join(host, "_host").checkpoint()
    k_path = _strength(both, "_path_sum", "_path_n", "_prior")
    fixed = {"_sum": float(total), "_n": float(n), "_k_host": k_host, "_k_path": k_path}
    return both.withColumns({c: F.lit(v) for c, v in fixed.items()}), mean


def site_mean() -> F.Column:
    """The path's posterior mean without the document's own probability, at any level."""
    p = F.col("_p")
    mean = F.when(F.col("_n") > 1, (F.col("_sum") - p) / (F.col("_n") - 1)).otherwise(0.5)
    host = (F.col("_host_sum") - p + F.col("_k_host") * mean) / (F.col("_host_n") - 1 + F.col("_k_host"))
    return (F.col("_path_sum") - p + F.col("_k_path") * host) / (F.col("_path_n") - 1 + F.col("_k_path"))


def _judge(rows: DataFrame, sites: DataFrame, base: float, small: bool) -> DataFrame:
    """Adds posterior and site means to rows with _host, _path, _log_odds and _p."""
    # A small table of sites goes to the rows; a large one meets them in a shuffle join.
    joined = rows.join(F.broadcast(sites) if small else sites, ["_host", "_path"])
    joined = joined.withColumn("_site", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), site_mean())))
    odds = F.col("_log_odds") - F.lit(base) + F.log(F.col("_site") / (1 - F.col("_site")))
    return joined.withColumn("_posterior", 1 / (1 + F.exp(-odds)))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, p_document, p_site, quality, keep) of every document."""
    prepare(docs.sparkSession)
    model = train(docs, labels, sample)
    scored = evidence(docs, model, [F.col("doc_id").cast("long").alias("doc_id")]).checkpoint()
    sites, _ = site_posteriors(scored)
    return _judge(scored, sites, model[3], sites.count() <= SITE_ROWS).select(
        "doc_id",
        F.col("_p").alias("p_document"),
        F.col("_site").alias("p_site"),
        F.col("_posterior").alias("quality"),
        (F.col("_posterior") >= keep_at).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are read twice. While sites are few, the second reading judges where it reads, and no text is shuffled. If they
    are many, narrow rows meet the sites, and what is rejected goes by a digest of text and site, never by the site, so
    that a large site does not gather in a task.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels, sample)
    digest = F.sha2(F.concat_ws("\x00", F.sha2(text_or_empty(), 256), _group("source"), _group("lang")), 256)
    narrow = evidence(docs, model, [digest.alias("_digest")])
    sites, _ = site_posteriors(narrow)
    if sites.count() > SITE_ROWS:
        bad = _judge(narrow, sites, model[3], False).where(F.col("_posterior") < keep_at).select("_digest").distinct().checkpoint()
        few = bad.count() <= BROADCAST_IDS
        bad = bad.toDF(free := free_name(docs, "_digest"))
        kept = docs.withColumn(free, digest).join(F.broadcast(bad) if few else bad, free, "left_anti")
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    # The documents' columns under numbers, which no name in here clashes with.
    carry = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    good = _judge(evidence(docs, model, carry), sites, model[3], True).where(F.col("_posterior") >= keep_at)
    return good.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))
