"""A live source of audio blocks: raw PCM that recorders append to, as a stream with offsets.

A recorder appends little-endian 32-bit floats, its channels interleaved, to `<path>/<session>.f32`, on any file system that the
executors know. The stream reader gives the first channel in blocks of `block` samples. Its offset is the number of whole blocks
of each session, so a query that restarts goes on where it stopped, and a block is read again as it was; what a recorder has
written of its next block waits. Each session with new blocks is read by tasks of its own, `task_blocks` blocks each.

    spark.dataSource.register(PcmBlocks)
    blocks = spark.readStream.format("pcm_blocks").option("path", folder).load()

Options: `path`; `block`, samples of a block (8000: half a second); `channels` (1); `rate` (16000). As a batch source it reads
what there is. Empty folders, and files that are no sessions, give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SUFFIX, SAMPLE = ".f32", 4
BLOCK, RATE, TASK_BLOCKS = 8_000, 16_000, 2_000
SCHEMA = "session long, block_idx long, at double, samples array<float>"
_ARROW = pa.schema([("session", pa.int64()), ("block_idx", pa.int64()), ("at", pa.float64()), ("samples", pa.list_(pa.float32()))])


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if urlsplit(path).scheme else "file://" + path)


class Blocks(InputPartition):
    def __init__(self, session: int, first: int, last: int):
        self.session, self.first, self.last = session, first, last


class _Recordings:
    """What recorders have written, in whole blocks."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.block, self.channels = int(options.get("block", BLOCK)), int(options.get("channels", 1))
        self.rate = int(options.get("rate", RATE))
        self.frame = self.block * self.channels * SAMPLE

    def counts(self) -> dict[str, int]:
        """Whole blocks by session."""
        from pyarrow import fs

        where, inner = _folder(self.path)
        files = where.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        own = {f.base_name.removesuffix(SUFFIX): f.size // self.frame for f in files if f.base_name.endswith(SUFFIX)}
        return {s: n for s, n in sorted(own.items()) if n and s.removeprefix("-").isdigit()}

    def split(self, start: dict[str, int], end: dict[str, int]) -> list[Blocks]:
        out = []
        for session, last in end.items():
            first = start.get(session, 0)
            out += [Blocks(int(session), a, min(a + TASK_BLOCKS, last)) for a in range(first, last, TASK_BLOCKS)]
        return out

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        import numpy as np

        where, inner = _folder(self.path)
        with where.open_input_file(f"{inner}/{part.session}{SUFFIX}") as f:
            f.seek(part.first * self.frame)
            step = max(1, (1 << 20) // self.frame)
            for a in range(part.first, part.last, step):
                n = min(step, part.last - a)
                data = np.frombuffer(f.read(n * self.frame), "<f4")
                if len(data) != n * self.block * self.channels:
                    raise ValueError(f"the recording of session {part.session} was cut short")
                mono = np.ascontiguousarray(data.reshape(-1, self.channels)[:, 0])
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.block)
                index = np.arange(a, a + n)
                columns = [np.full(n, part.session), index, index * (self.block / self.rate)]
                lists = pa.ListArray.from_arrays(offsets, pa.array(mono))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], schema=_ARROW)


class PcmBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Recordings(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Recordings(self.options))


class _Batch(DataSourceReader):
    def __init__(self, recordings: _Recordings):
        self.recordings = recordings

    def partitions(self) -> list[Blocks]:
        return self.recordings.split({}, self.recordings.counts()) or [Blocks(0, 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        return self.recordings.read(partition) if partition.last else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, recordings: _Recordings):
        self.recordings = recordings

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.recordings.counts()

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return self.recordings.split(start, end)

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        return self.recordings.read(partition)
