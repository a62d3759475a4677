"""Transcripts of audio windows by a given speech model: one model per task, Arrow batches in and out.

No model comes with this package. `load()` makes one where the work is done and gives a callable
`decode(samples, language)` that returns segments (start, end, text); `language` is None where it is not pinned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal as G

Decode = Callable[[np.ndarray, str | None], list[tuple[float, float, str]]]
OUT = "session long, window_idx long, silent boolean, segments array<struct<start:double,end:double,text:string>>"


def transcribe(windows: DataFrame, load: Callable[[], Decode], language: str | None = None) -> DataFrame:
    """(session, window_idx, silent, segments) of windows (session, window_idx, samples).

    A window at or below the energy gate is silent and is not decoded. Others are amplified first. A model that does not
    know the pinned language (ValueError) is asked again without it, and from then on; any other failure gives
    no segments. Blank segments are left out.
    """
    ready = windows.select(
        F.col("session").cast("long"), F.col("window_idx").cast("long"), (~G.has_voice(F.col("samples"))).alias("silent"),
        G.auto_gain(F.col("samples")).alias("samples"),
    )
    kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, pinned = load(), language

        def segments(samples: list[float]) -> list[dict]:
            nonlocal pinned
            x = np.array(samples, np.float32)
            try:
                try:
                    found = decode(x, pinned)
                except ValueError:
                    if pinned is None:
                        raise
                    pinned = None
                    found = decode(x, None)
            except Exception:  # a window that can't be decoded says nothing
                return []
            return [{"start": a, "end": b, "text": t.strip()} for a, b, t in found if t.strip()]

        for batch in batches:
            said = [[] if quiet or x is None else segments(x) for quiet, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(said, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["session", "window_idx", "silent", "segments"])

    return ready.mapInArrow(run, OUT)
