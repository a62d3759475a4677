"""DataFrames that are read several times are kept; a scope releases what was kept or shared inside it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession

_kept: ContextVar[list[DataFrame | Broadcast] | None] = ContextVar("kept", default=None)


def keep(df: DataFrame) -> DataFrame:
    """Persist a DataFrame, on disk where memory is short; the scope around releases it."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (own := _kept.get()) is not None:
        own.append(df)
    return df


def share(spark: SparkSession, value: Any) -> Broadcast:
    """A value for all tasks."""
    shared = spark.sparkContext.broadcast(value)
    if (own := _kept.get()) is not None:
        own.append(shared)
    return shared


@contextmanager
def released() -> Iterator[None]:
    """What is kept inside is released at the end, whether the work succeeds or not.

    A micro-batch runs in such a scope: a stream would otherwise fill the executors. Batch plans, which are read
    after they are made, stay outside.
    """
    own: list[DataFrame | Broadcast] = []
    token = _kept.set(own)
    try:
        yield
    finally:
        _kept.reset(token)
        for x in own:
            x.unpersist()
