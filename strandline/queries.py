"""All queries of the tracking engine, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import match_queries, text_queries, track_queries, window_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["topk_candidates"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "entry"]
