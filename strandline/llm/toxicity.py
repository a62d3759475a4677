"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

Grades are ordered: 0 is clean, 1 to `levels` ever more severe. One weight vector w is shared by all
thresholds theta_1 < theta_2 < ...:

    P(grade >= k) = sigmoid(w . x - theta_k),    expected severity = sum over k of P(grade >= k)

x holds the presence of the words of the text. w and the thresholds maximise the likelihood of the grades,
the sum of log(P(grade >= y) - P(grade >= y + 1)), less a ridge on w; the thresholds are a first one
and positive steps, so their order needs no force.

The labels only say clean or toxic. A toxic document's grade comes from how often it has telling words, repeats
included, which the presence of words does not hold: words that the other half of the sample shows almost only
in toxic documents are telling, and a grade rises by one at each `levels`-th of the numbers. No document takes
part in the list that grades it.

The model is fitted on at most `sample` labelled documents, chosen by hash and at most half of them of each
class, weighted back to the classes' shares. Words are counted in Spark; every word of `LEAST_DF` documents of the
sample or more whose log odds between toxic and clean documents stand `LEAST_Z` standard errors from 0 gets a
weight, whatever their number; others have none, so length alone moves nothing. The driver gets these words, and of each
document of the sample the numbers of those it holds. Scoring covers all documents and whole texts.

Defined cases: null texts are empty and get the severity of no words; null or missing labels, or labels of
one class, give severity 0 to all; a document labelled twice takes the higher label; rows that repeat a
doc_id are scored each, and the one with the smallest list of words is that of the label; numbers that tie have the
same grade; of equally likely grades the lowest is reported; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_or_empty
from .quality import sigmoid

SAMPLE, LEVELS, TOXIC_AT = 8_000, 3, 0.5
LEAST_DF, LEAST_Z, L2, STEPS = 5, 3.5, 0.01, 300
#: Words that grade: so many times as frequent in toxic documents, and in at least this share of them.
TELLING, LEAST_SHARE = 50, 0.02
PREFIX = 5
_WORD = re.compile(r"[^\W_]+")


def counted(text: str) -> Counter:
    """How often a text has each word, and each beginning (`PREFIX` letters and a star) of longer ones."""
    words = Counter(_WORD.findall(text.lower()))
    starts = Counter()
    for w, n in words.items():
        if len(w) > PREFIX:
            starts[w[:PREFIX] + "*"] += n
    return words + starts


def words_of(text: str) -> set[str]:
    """The features of a text: its distinct words, and the beginnings of longer ones."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(LEVELS, 40.0))

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        own = self.weights.keys() & words_of(text)
        return sigmoid(sum(self.weights[w] for w in sorted(own)) - self.thresholds)


# -- the likelihood -----------------------------------------------------------------------------


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0.0, -x)


@dataclass
class Rows:
    """A sparse matrix of ones: the features of row i are index[start[i]:start[i + 1]]."""

    index: np.ndarray
    start: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: list[np.ndarray], width: int) -> Rows:
        start = np.cumsum([0] + [len(r) for r in rows])
        return cls(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), start, width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(w[self.index])])[self.start])

    def transposed_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, np.repeat(v, np.diff(self.start)), self.width)


def thresholds_of(z: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the steps."""
    return z[0] + np.concatenate([[0.0], np.cumsum(np.exp(z[1:]))])


def loss(params: np.ndarray, x: Rows, grade: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Negative weighted log likelihood of the grades with a ridge on the weights, and its gradient."""
    w, z = params[: x.width], params[x.width :]
    theta, levels = thresholds_of(z), len(z)
    eta = x.dot(w)
    low, high = grade > 0, grade < levels
    a, b = eta - theta[np.maximum(grade - 1, 0)], eta - theta[np.minimum(grade, levels - 1)]
    both = low & high
    # sigmoid(a) - sigmoid(b) = sigmoid(a) sigmoid(-b) (1 - exp(b - a)), each factor only where it has a bound.
    step = np.where(both, np.minimum(b - a, -1e-12), -np.inf)
    gap = np.exp(step)
    ll = np.where(low, _log_sigmoid(a), 0.0) + np.where(high, _log_sigmoid(-b), 0.0) + np.log1p(-gap)
    by_a = np.where(low, sigmoid(-a), 0.0) + gap / (1 - gap)
    by_b = np.where(high, -sigmoid(b), 0.0) - gap / (1 - gap)
    by_eta = -weight * (by_a + by_b)
    by_theta = np.bincount(grade[low] - 1, (weight * by_a)[low], levels) + np.bincount(grade[high], (weight * by_b)[high], levels)
    # theta_k moves with z_0 and with every step up to it.
    tail = np.cumsum(by_theta[::-1])[::-1]
    by_z = np.concatenate([[tail[0]], tail[1:] * np.exp(z[1:])])
    value = -(weight * ll).sum() + 0.5 * l2 * (w @ w) + 0.5e-3 * (z[1:] @ z[1:])
    return float(value), np.concatenate([x.transposed_dot(by_eta) + l2 * w, by_z + 1e-3 * np.append(0.0, z[1:])])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = STEPS, kept: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps, each halved until the value falls enough."""
    value, gradient = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(gradient).max() < 1e-5:
            break
        q, coefficients = gradient.copy(), []
        for s, y, rho in reversed(past):
            c = rho * (s @ q)
            coefficients.append(c)
            q -= c * y
        if past:
            s, y, rho = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), c in zip(past, reversed(coefficients)):
            q += s * (c - rho * (y @ q))
        slope = gradient @ q
        size = 1.0 if past else min(1.0, 1.0 / np.abs(gradient).sum())
        while True:
            new = x - size * q
            new_value, new_gradient = f(new)
            if new_value <= value - 1e-4 * size * slope or size < 1e-12:
                break
            size /= 2
        s, y = new - x, new_gradient - gradient
        if size < 1e-12:
            break
        if s @ y > 1e-12:
            past = [*past[1 - kept :], (s, y, 1.0 / (s @ y))]
        x, value, gradient = new, new_value, new_gradient
    return x


def fit(x: Rows, grade: np.ndarray, levels: int, weight: np.ndarray, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model."""
    share = np.clip([(weight * (grade >= k)).sum() / weight.sum() for k in range(1, levels + 1)], 1e-4, 1 - 1e-4)
    theta = np.log((1 - share) / share)
    z = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    best = minimise(lambda p: loss(p, x, grade, weight, l2), np.concatenate([np.zeros(x.width), z]))
    return best[: x.width], thresholds_of(best[x.width :])


# -- the sample ---------------------------------------------------------------------------------


def grades(told: np.ndarray, toxic: np.ndarray, levels: int) -> np.ndarray:
    """0 of clean documents; of toxic ones 1 and one more for each `levels`-th of the numbers that theirs is above."""
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    cuts = np.quantile(told[toxic == 1], np.arange(1, levels) / levels)
    return np.where(toxic == 1, 1 + (told[:, None] > cuts).sum(axis=1), 0)


def _informative(bad: Column, df: Column, n_bad: int, n_good: int) -> Column:
    """The smoothed log odds between toxic and clean documents differ from 0 by LEAST_Z errors."""
    a, b = bad + 0.5, df - bad + 0.5
    odds = F.log(a / (n_bad + 1 - a)) - F.log(b / (n_good + 1 - b))
    error = F.sqrt(1 / a + 1 / (n_bad + 1 - a) + 1 / b + 1 / (n_good + 1 - b))
    return (df >= LEAST_DF) & (F.abs(odds / error) >= LEAST_Z)


def _telling(bad: Column, df: Column, n_bad: int, n_good: int) -> Column:
    share = bad / max(1, n_bad)
    return (bad >= LEAST_DF) & (share >= LEAST_SHARE) & (share >= TELLING * (df - bad + 0.5) / max(1, n_good))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, levels: int = LEVELS) -> Model:
    none = Model(thresholds=np.full(levels, 40.0))
    one = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("double").alias("y")).dropna()
    one = one.groupBy("doc_id").agg(F.max("y").alias("y"))
    total, bad = one.agg(F.count("*"), F.sum("y")).first()
    # Half of the sample is toxic, if there are as many: it is the rare class that the words are learned from.
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    few = one.where("y > 0").orderBy(*order).limit(sample // 2)
    one = few.union(one.where("y = 0").orderBy(*order).limit(sample - sample // 2))
    chosen = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(F.broadcast(one), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted(counted(t).items()) for t in batch.column(1).to_pylist()]
            words, times = [[w for w, _ in x] for x in each], [[n for _, n in x] for x in each]
            columns = [pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "y", "words", "times"])

    rows = chosen.select("doc_id", "text", "y").mapInArrow(count, "doc_id long, y double, words array<string>, times array<long>")
    # One row of a repeated doc_id.
    one_each = F.min(F.struct("words", "times", "y")).alias("x")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    rows = rows.groupBy("doc_id").agg(one_each).select("doc_id", half, "x.*").checkpoint()
    sizes = {(r.half, int(r.y)): r.n for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    n = [[sizes.get((h, y), 0) for y in (0, 1)] for h in (0, 1)]
    n_good, n_bad = n[0][0] + n[1][0], n[0][1] + n[1][1]
    if not n_good or not n_bad:
        return none
    sums = [F.sum((F.col("half") == h).cast("long") * (F.col("y") if y else F.lit(1))).alias(f"{k}{h}") for h in (0, 1) for k, y in (("df", 0), ("bad", 1))]
    by_word = rows.select("half", "y", F.explode("words").alias("word")).groupBy("word").agg(*sums)
    both = [F.col("bad0") + F.col("bad1"), F.col("df0") + F.col("df1")]
    flags = [_informative(*both, n_bad, n_good).alias("feature")]
    flags += [_telling(F.col(f"bad{h}"), F.col(f"df{h}"), n[h][1], n[h][0]).alias(f"told{h}") for h in (0, 1)]
    found = by_word.select("word", *flags).where("feature OR ((told0 OR told1) AND word NOT LIKE '%*')").orderBy("word").collect()
    features = [r.word for r in found if r.feature]
    if not features:
        return none
    number = {w: i for i, w in enumerate(features)}
    lists = [frozenset(r.word for r in found if r[f"told{h}"] and r.word[-1] != "*") for h in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast((number, lists))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, lists = shared.value
        for batch in batches:
            own, told = [], []
            for half, words, times in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own.append([number[w] for w in words if w in number])
                told.append(sum(n for w, n in zip(words, times) if w in lists[1 - half]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), pa.array(own, pa.list_(pa.int64())), pa.array(told, pa.int64())], ["doc_id", "y", "x", "told"]
            )

    narrow = rows.select("doc_id", "half", "words", "times", "y")
    got = narrow.mapInArrow(index, "doc_id long, y double, x array<long>, told long").orderBy("doc_id").toArrow()
    toxic = got.column("y").to_numpy().astype(int)
    grade = grades(got.column("told").to_numpy(), toxic, levels)
    own, share = toxic.mean(), min(max((bad or 0) / max(1, total), 1e-3), 1 - 1e-3)
    weight = np.where(toxic == 1, share / own, (1 - share) / (1 - own))
    x = Rows.of([np.array(i, np.int64) for i in got.column("x").to_pylist()], len(features))
    w, theta = fit(x, grade, levels, weight)
    return Model({features[i]: float(w[i]) for i in np.flatnonzero(w)}, theta)


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, toxic_at: float = TOXIC_AT) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) of every document; grade is the likeliest one."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, labels, sample))  # bounded by the words of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = np.array([model.at_least(t) for t in batch.column(1).to_pylist()]).reshape(len(batch.column(1)), -1)
            full = np.column_stack([np.ones(len(p)), p, np.zeros(len(p))])
            grade = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
            columns = [batch.column(0), pa.array(p.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(full[:, 1])]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array((full[:, 1] >= toxic_at).astype(np.int32))],
                ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(
        run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic int"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
