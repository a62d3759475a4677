"""Blocks of audio put together: chunks of a step each, and the window that ends with each chunk.

A chunk takes blocks until it has `step` samples; what the last one has beyond them is dropped, not carried over. The window
is the last `window` samples up to the end of the chunk, with zeros before the first. One function does both, in batch as an ordered
fold and in a stream by typed state: the samples of the chunk that is not complete and those of the window, so its size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row

from . import ordered
from .state import Sessions, use_typed_state

STEP, WINDOW = 48_000, 160_000
CHUNKS = "session long, chunk_idx long, n_blocks int, first_block long, samples array<float>, window array<float>"
_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


class Chunker:
    """A session's blocks in order; `add` gives a chunk (CHUNKS without the session) when it is complete."""

    def __init__(self, step: int, window: int, made: int = 0, seen: int = -1, first: int = -1, n: int = 0, held: bytes = b"", before: bytes = b""):
        self.step, self.window = step, window
        self.made, self.seen, self.first, self.n, self.held, self.before = made, seen, first, n, held, before

    def state(self) -> tuple:
        return self.made, self.seen, self.first, self.n, self.held, self.before

    def add(self, block: int, samples) -> tuple | None:
        if block <= self.seen:
            return None  # a block that comes late or again
        self.seen, self.n = block, self.n + 1
        self.first = block if self.n == 1 else self.first
        self.held += np.asarray(samples if samples is not None else [], "<f4").tobytes()
        if len(self.held) < 4 * self.step:
            return None
        chunk = self.held[: 4 * self.step]
        whole = (self.before + chunk)[-4 * self.window :] if self.window else b""
        out = (self.made, self.n, self.first, self._list(chunk), self._list(whole.rjust(4 * self.window, b"\0")))
        self.made, self.n, self.held, self.before = self.made + 1, 0, b"", whole
        return out

    @staticmethod
    def _list(data: bytes) -> list[float]:
        return np.frombuffer(data, "<f4").tolist()


def chunks(blocks: DataFrame, step: int = STEP, window: int = WINDOW) -> DataFrame:
    """CHUNKS of all blocks (session, block_idx, samples); the incomplete last one of a session is dropped."""

    def one(state: Chunker, row: dict):
        if (made := state.add(row["block_idx"], row["samples"])) is not None:
            yield row["session"], *made

    rows = blocks.selectExpr("cast(session AS long) AS session", "cast(block_idx AS long) AS block_idx", "samples")
    return ordered.fold(rows, "session", ["block_idx"], lambda: Chunker(step, window), one, CHUNKS)


class _Chunks(Sessions):
    def __init__(self, step: int, window: int, idle: int | None):
        super().__init__(idle)
        self.step, self.window = step, window

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("chunk", "made long, seen long, first long, n int, held binary, before binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.touch(timerValues)
        c = Chunker(self.step, self.window, *(self.kept.get() if self.kept.exists() else ()))
        c.held, c.before = bytes(c.held), bytes(c.before)
        made = []
        for row in sorted(rows, key=lambda r: r["block_idx"]):
            if (chunk := c.add(row["block_idx"], row["samples"])) is not None:
                made.append((row["session"], *chunk))
        self.kept.update(c.state())
        for chunk in made:
            yield Row(**dict(zip(_NAMES, chunk)))

    def forget(self) -> None:
        self.kept.clear()


def chunk_stream(blocks: DataFrame, step: int = STEP, window: int = WINDOW, idle: int | None = None) -> DataFrame:
    """`chunks` of a stream of blocks; blocks at or before the last one of an earlier micro-batch are dropped."""
    use_typed_state(blocks.sparkSession)
    rows = blocks.selectExpr("cast(session AS long) AS session", "cast(block_idx AS long) AS block_idx", "samples")
    mode = "ProcessingTime" if idle else "None"
    return rows.groupBy("session").transformWithState(_Chunks(step, window, idle), CHUNKS, "append", mode)
