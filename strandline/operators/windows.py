"""Windows and running values per session, in processing order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..streaming.ordered import fold


def tumble(levels: DataFrame, blocks: int) -> DataFrame:
    """Chunks of a number of blocks; the incomplete last one is dropped."""
    chunk = F.floor((F.col("window_idx") - 1) / blocks).cast("int").alias("chunk_idx")
    square = F.col("level") * F.col("level")
    return (
        levels.groupBy("session", chunk)
        .agg(F.count("*").alias("n_blocks"), F.min("ts").alias("start_ts"), F.round(F.sqrt(F.avg(square)), 6).alias("rms"))
        .where(F.col("n_blocks") == blocks)
    )


def slide(levels: DataFrame, blocks: int) -> DataFrame:
    """Sliding windows that end at each block, as if zeros came before the first."""
    w = W.partitionBy("session").orderBy("window_idx").rowsBetween(1 - blocks, 0)
    rms = F.sqrt(F.sum(F.col("level") * F.col("level")).over(w) / blocks)
    return levels.select("session", "window_idx", F.round(rms, 6).alias("rms"), F.max(F.abs("level")).over(w).alias("peak"))


def slide_by_time(
    levels: DataFrame, length: str, step: str, offset: str, watermark: str | None = None, key: str = "session", at: str = "t", value: str = "level"
) -> DataFrame:
    """Sliding windows of event time (key, window_end, n, level). A stream needs a `watermark`: a window comes out, once, when it has
    passed the window's end, and rows that are later than it are left out."""
    rows = levels.withWatermark(at, watermark) if watermark else levels
    w = rows.groupBy(key, F.window(at, length, step, offset).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("level"))
    return w.select(key, F.col("w.end").alias("window_end"), "n", "level")


def vocal_breaks(levels: DataFrame) -> DataFrame:
    """Length of the running silence, and the windows that end one and start the boost."""
    order = W.partitionBy("session").orderBy("window_idx")
    voiced = F.col("has_vocals").cast("int")
    islands = levels.withColumns(
        {"_island": F.sum(voiced).over(order), "_before": F.coalesce(F.lag("has_vocals").over(order), F.lit(True))}
    )
    run = F.sum(1 - voiced).over(W.partitionBy("session", "_island").orderBy("window_idx"))
    ends = F.col("has_vocals") & ~F.col("_before")
    return islands.select(
        "session",
        "window_idx",
        "has_vocals",
        run.alias("silence_run"),
        ends.alias("break_end"),
        F.when(ends, C.BOOST_WINDOWS).otherwise(0).alias("boost"),
    )


def speech_rate(windows: DataFrame, seconds: float = 10.0) -> DataFrame:
    """Smoothed letters per second of each window, by a fold over the session's ordered windows."""
    seconds = max(seconds, 0.1)
    alpha = min(0.99, max(0.01, C.RATE_ALPHA))

    def step(state: dict, row: dict):
        r = state["r"]
        state["r"] = r * C.SILENT_RATE if row["silent"] else (1 - alpha) * r + alpha * (row["n"] / seconds)
        yield row["session"], row["window_idx"], state["r"]

    rows = windows.select(
        F.col("session").cast("long"), F.col("window_idx").cast("long"), "silent", F.char_length("letters").alias("n")
    )
    return fold(rows, "session", ["window_idx"], lambda: {"r": 0.0}, step, "session long, window_idx long, rate double")


def with_profile(windows: DataFrame, mode: str = "mode") -> DataFrame:
    """Adds the parameters of each row's mode; the profiles are three rows, so they are broadcast."""
    spark = windows.sparkSession
    known = F.when(F.col(mode).isin(*C.PROFILES), F.col(mode)).otherwise(C.BALANCED.name)
    profiles = spark.createDataFrame(C.profile_rows()).withColumnRenamed("name", mode)
    return windows.withColumn(mode, known).join(F.broadcast(profiles), mode)


def previous_key(windows: DataFrame) -> DataFrame:
    """The last key of enough letters since the last silent window; empty in a silent window itself."""
    order = W.partitionBy("session").orderBy("window_idx")
    parts = windows.withColumn("_part", F.sum(F.col("silent").cast("int")).over(order))
    before = W.partitionBy("session", "_part").orderBy("window_idx").rowsBetween(W.unboundedPreceding, -1)
    usable = F.when(~F.col("silent") & (F.char_length("letters") >= C.MIN_LETTERS), F.col("letters"))
    last = F.coalesce(F.last(usable, ignorenulls=True).over(before), F.lit(""))
    return parts.withColumn("prev_key", F.when(F.col("silent"), "").otherwise(last)).drop("_part")
