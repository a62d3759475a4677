"""Many keys meet many lines: each query by its head, a beginning of a fixed choice of lengths, as a hash.

The heads of the queries are marked in a bitmap whose size is bounded; a task hashes the beginnings at all places of its lines at once
and lets only those that are marked leave it. What meets is compared in full afterwards, so neither equal hashes nor a
full bitmap change a result. Lines are taken in a few parts, in the order in which hits count: a query that has all its
hits is not asked of later parts, so a frequent key does not meet every line that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Lengths of heads; a query has the longest that fits.
HEADS = (3, 4, 5, 6, 7, 8, 12, 16)
#: Bits a query, and bounds of the bitmap's size: 16 MB at most.
BITS, LEAST, MOST = 16, 1 << 16, 1 << 27


def hashes(keys: list[str | None], anywhere: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of keys, hashes) of what begins at each place, or at the start, of the keys."""
    keys = [k or "" for k in keys]
    start = np.cumsum([0] + [len(k) for k in keys])
    letters = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(keys)), np.diff(start))
    at = np.arange(len(letters)) if anywhere else start[:-1][np.diff(start) > 0]
    left = start[row + 1] - np.arange(len(letters))
    h = np.zeros(len(at), np.uint64)
    for n in range(1, HEADS[-1] + 1):
        fits = left[at] >= n
        at = at[fits]
        h = h[fits] * np.uint64(0x9E3779B97F4A7C15) + letters[at + n - 1] + np.uint64(1)
        if n in HEADS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            yield n, row[at], (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


@pandas_udf(LongType())
def head(keys: pd.Series) -> pd.Series:
    """The hash of a query's head; 0 for queries shorter than any."""
    size = np.array([len(k or "") for k in keys], np.int64)
    longest = np.array((0, *HEADS))[np.searchsorted(HEADS, size, "right")]
    out = np.zeros(len(size), np.int64)
    for n, row, h in hashes(keys.tolist(), False):
        mine = longest[row] == n
        out[row[mine]] = h[mine]
    return pd.Series(out)


def bitmap(asked: DataFrame) -> np.ndarray:
    """The hashes `k` of some queries as bits, put together by the executors."""
    size = LEAST
    while size < min(MOST, BITS * asked.count()):
        size *= 2
    place = F.col("k").bitwiseAND(F.lit(size - 1))
    words = asked.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b"))
    marked = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[marked.column("w").to_numpy()] = marked.column("b").to_numpy()
    return bits.view(np.uint64)


def meeting(lines: DataFrame, asked: DataFrame, anywhere: bool) -> DataFrame:
    """(the lines' columns, `k`): lines once for each marked head that they have, at their start or at any place of `letters`."""
    schema = StructType([*lines.schema.fields, StructField("k", LongType())])
    arrow, names = to_arrow_schema(schema), lines.columns
    shared = lines.sparkSession.sparkContext.broadcast(bitmap(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, ks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, row, h in hashes(batch.column(names.index("letters")).to_pylist(), anywhere):
                place = h.view(np.uint64) & np.uint64(64 * len(bits) - 1)
                marked = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                rows.append(row[marked])
                ks.append(h[marked])
            row, k = np.unique(np.stack([np.concatenate(rows), np.concatenate(ks)]), axis=1)
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(k)], schema=arrow)

    return lines.mapInArrow(run, schema)
