"""Alignment of windows with the lines of a work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import score as S
from ..functions.similarity import similarity


def with_similarity(pairs: DataFrame, query: str, line: str) -> DataFrame:
    """Adds ratio and run, compared in Arrow batches."""
    compared = pairs.withColumn("_s", similarity(F.col(query), F.col(line)))
    return compared.select(*pairs.columns, "_s.ratio", "_s.run")


def variants(current: Column, previous: Column) -> Column:
    """The current key and, after a previous one, both orders of the two: (label, query)."""
    one = lambda label, q: F.struct(F.lit(label).alias("label"), q.alias("query"))
    both, back = F.concat(previous, current), F.concat(current, previous)
    stitched = F.array_compact(
        F.array(
            F.when((previous != "") & (current != ""), one("prev_current", both)),
            F.when((previous != "") & (current != "") & (both != back), one("current_prev", back)),
            F.when((previous != "") & (current == ""), one("prev_current", previous)),
        )
    )
    return F.concat(F.array(one("current", current)), stitched)


def align(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """Line scores of each window (session, window_idx, work_id, query, current) with all lines of its work.

    `current` is the line the session is at. Adds line_idx, raw (no bias) and score (with it).
    """
    pairs = windows.join(lines.select("work_id", "line_idx", F.col("letters").alias("line")), "work_id")
    scored = with_similarity(pairs, "query", "line")
    raw = S.line_score(F.col("ratio"), F.col("run"), F.col("query"), F.col("line"))
    return scored.withColumn("raw", raw).withColumn(
        "score", S.progression(F.col("line_idx"), F.col("current"), F.col("raw"))
    )


def best_line(aligned: DataFrame, *keys: str) -> DataFrame:
    """The line of the highest score; the lowest index of equal ones, and index 0 if nothing scores."""
    top = F.max(F.struct("score", (-F.col("line_idx")).alias("back"))).alias("top")
    best = aligned.groupBy(*keys).agg(top)
    idx = F.when(F.col("top.score") > 0, -F.col("top.back")).otherwise(0)
    return best.select(*keys, idx.alias("best_idx"), F.col("top.score").alias("best_score"))


def best_of_variants(aligned: DataFrame, *keys: str) -> DataFrame:
    """`best_line` per variant `label`; a stitched key is taken only if it is strictly better than the current one."""
    each = best_line(aligned, *keys, "label")
    rank = F.when(F.col("label") == "current", 2).when(F.col("label") == "prev_current", 1).otherwise(0)
    top = each.groupBy(*keys).agg(F.max(F.struct("best_score", rank.alias("rank"), "best_idx", "label")).alias("x"))
    return top.select(*keys, "x.best_idx", "x.best_score", F.col("x.label").alias("variant"))


def local_best(aligned: DataFrame, *keys: str) -> DataFrame:
    """The best line near the current one; equal scores prefer the current line, then the lowest index."""
    near = aligned.where(F.abs(F.col("line_idx") - F.col("current")) <= C.LOCAL_RADIUS)
    here = (F.col("line_idx") == F.col("current")).alias("here")
    top = F.max(F.struct("score", here, (-F.col("line_idx")).alias("back"))).alias("top")
    return near.groupBy(*keys).agg(top).select(
        *keys, (-F.col("top.back")).alias("local_idx"), F.col("top.score").alias("local_score")
    )
