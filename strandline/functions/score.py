"""Scores as column expressions. Terms are added from left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def context_free(ratio: Column, run: Column, query: Column, line: Column, source: Column) -> Column:
    """Score without knowledge of a current work; 0 where a key is empty."""
    return score(ratio, run, query, line, source, F.lit(False))


def score(ratio: Column, run: Column, query: Column, line: Column, source: Column, is_current: Column) -> Column:
    share = run / F.greatest(F.char_length(query), F.lit(1))
    total = (
        F.lit(C.WEIGHT_RATIO) * ratio
        + F.lit(C.WEIGHT_RUN) * share
        + F.lit(C.WEIGHT_CONTEXT) * F.when(is_current, 1.0).otherwise(0.5)
        + F.lit(C.WEIGHT_SOURCE) * F.when(F.coalesce(source, F.lit("G")) == "G", 1.0).otherwise(0.5)
    )
    return F.when((query == "") | (line == ""), F.lit(0.0)).otherwise(total)


def line_score(ratio: Column, run: Column, query: Column, line: Column) -> Column:
    share = run / F.greatest(F.char_length(query), F.lit(1))
    return F.when((query == "") | (line == ""), F.lit(0.0)).otherwise(F.lit(0.5) * ratio + F.lit(0.5) * share)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def with_bonus(base: Column, by_phrase: Column, overlap: Column) -> Column:
    bonus = F.when(by_phrase & (overlap >= 2), C.BONUS_TWO).when(by_phrase & (overlap >= 1), C.BONUS_ONE).otherwise(0.0)
    return clamp(base + bonus)


def classify(score_: Column, auto: float | Column = C.BALANCED.auto, suggest: float | Column = C.BALANCED.suggest) -> Column:
    """On the unrounded score."""
    return F.when(score_ >= auto, "auto").when(score_ >= suggest, "suggest").otherwise("ignore")


def progression(index: Column, current: Column, raw: Column) -> Column:
    """A line's score with the bias for the expected order of lines."""
    d = index - current
    bias = (
        F.when(d == 0, 0.12)
        .when(d == 1, 0.16)
        .when(d == 2, 0.10)
        .when(d < 0, F.lit(-0.04) * F.least(F.abs(d), F.lit(3)))
        .when(d >= 4, -0.08)
        .otherwise(F.lit(-0.02) * F.abs(d))
    )
    return F.when(raw >= C.BYPASS, raw).otherwise(clamp(raw + bias))


def lockable(raw: Column, evidence: Column, stability: Column, overlap: Column, p: C.Profile = C.BALANCED) -> Column:
    by_raw = (raw >= p.auto) & (overlap >= p.overlap_auto)
    by_evidence = (evidence >= p.auto) & (stability >= p.lock_windows) & (overlap >= p.overlap_evidence)
    return (raw >= p.min_raw) & (by_raw | by_evidence)


def instant_lock(raw: Column, overlap: Column, p: C.Profile = C.BALANCED) -> Column:
    return (raw >= p.instant) & (overlap >= p.overlap_instant)


def instant_switch(raw: Column, current: Column, overlap: Column, p: C.Profile = C.BALANCED) -> Column:
    return (raw >= p.switch_score) & (overlap >= p.overlap_switch) & (raw - current >= p.switch_margin)


def window_mode(boost: Column, state: Column, weak: Column, rate: Column) -> Column:
    locked = state.isin("locked", "unstable_lock")
    return (
        F.when(boost > 0, "start_boost")
        .when(locked & ((state == "unstable_lock") | (weak > 0)), "locked_recover")
        .when(locked & (rate >= C.FAST_RATE), "locked_fast")
        .when(locked & (rate <= C.SLOW_RATE), "locked_slow")
        .when(locked, "locked_follow")
        .when(rate >= C.FAST_RATE, "search_fast")
        .otherwise("search")
    )


def window_seconds(mode: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, seconds in C.SECONDS.items():
        out = F.when(mode == name, seconds).otherwise(out)
    return out
