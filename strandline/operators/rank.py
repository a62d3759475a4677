"""Scoring and ranking of retrieved works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import score as S
from ..functions import text as T
from .align import with_similarity


def score_candidates(queries: DataFrame, candidates: DataFrame, script: T.Script = T.LATIN) -> DataFrame:
    """Adds ratio, run, base, overlap, full (with bonus), score (3 digits) and action to merged candidates."""
    q = queries.select("qid", F.col("letters").alias("query"), F.col("text").alias("transcript"))
    pairs = with_similarity(candidates.join(q, "qid"), "query", "letters")
    base = S.context_free(F.col("ratio"), F.col("run"), F.col("query"), F.col("letters"), F.col("source"))
    scored = pairs.withColumn("base", base).withColumn(
        "overlap", T.word_overlap(F.col("transcript"), F.col("text"), script)
    )
    full = S.with_bonus(F.col("base"), F.array_contains("tags", "type2"), F.col("overlap"))
    scored = scored.withColumn("full", full)
    return scored.withColumns({"score": F.round("full", 3), "action": S.classify(F.col("full"))})


def rank(scored: DataFrame) -> DataFrame:
    """Adds `rank`: by the rounded score, equal ones in the order of retrieval."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), "place")
    return scored.withColumn("rank", F.row_number().over(order))


def top(scored: DataFrame, k: int = C.TOP) -> DataFrame:
    return rank(scored).where(F.col("rank") <= k)


def choose(ranked: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """The candidate of each query's best hypothesis (qid, hyp_work, evidence, stability), or else the first one.

    Adds raw, evidence and stability: those of the hypothesis if its work was found, else the score's own.
    """
    joined = ranked.join(hypotheses, "qid", "left")
    found = F.col("work_id").eqNullSafe(F.col("hyp_work"))
    best = W.partitionBy("qid").orderBy(F.desc(found), "rank")
    one = joined.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return one.select(
        *ranked.columns,
        F.col("score").alias("raw"),
        F.when(found, F.round("evidence", 3)).otherwise(F.col("score")).alias("evidence"),
        F.when(found, F.col("stability")).otherwise(1).cast("int").alias("stability"),
    )


def current_scores(ranked: DataFrame, current: DataFrame) -> DataFrame:
    """(qid, current_id, current_score): the score of each query's current work, 0 if it was not retrieved."""
    hit = ranked.select("qid", F.col("work_id").alias("current_id"), F.col("score").alias("current_score"))
    return current.join(hit, ["qid", "current_id"], "left").select(
        "qid", "current_id", F.coalesce("current_score", F.lit(0.0)).alias("current_score")
    )
