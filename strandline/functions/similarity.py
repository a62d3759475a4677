"""Similarity of letter keys: Ratcliff and Obershelp's matched share, and the longest common run.

Pairs are compared in Arrow batches. The recursion (longest common run, then the same to its left and right)
goes level by level over all pairs of a batch at once, as array operations on the letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: From this length on the matcher of the standard library leaves out letters that are frequent in the second key.
FREQUENT_FROM = 200
#: Cells that are looked at together; bounds the memory of a batch.
CELLS = 1 << 19
#: Pairs that are compared together.
PAIRS = 80_000


def ratio_and_run(a: str | None, b: str | None) -> tuple[float, int]:
    """(matched share 2M/T, longest common run) of two strings, in this order of arguments."""
    if not a or not b:
        return 0.0, 0
    m = SequenceMatcher(None, a, b)
    # The whole matching is kept by the matcher; the first call finds the longest run of all.
    return m.ratio(), m.find_longest_match(0, len(a), 0, len(b)).size


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all keys as numbers, where each key begins)."""
    start = np.cumsum([0] + [len(k) for k in keys])
    return np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32), start


def _small(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of both sides in few bits: those that only one side has are one number; the two highest numbers stay free."""
    common = np.intersect1d(a, b)
    kind = np.uint8 if len(common) < 250 else np.uint16 if len(common) < 65_000 else np.int32
    out = []
    for x, other in ((a, 1), (b, 2)):
        at = np.minimum(np.searchsorted(common, x), max(len(common) - 1, 0))
        hit = common[at] == x if len(common) else np.zeros(len(x), bool)
        out.append(np.where(hit, at + 3, other).astype(kind))
    return out[0], out[1]


def _longest(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, end in a, end in b) of the longest common run of each row of `at`: a's range, then b's range.

    Of equally long runs the one that ends first in a counts, and of these the one that ends first in b. Pairs lie side by
    side, letters below each other, so that each step is one operation over all pairs.
    """
    high, wide = at[:, 1] - at[:, 0], at[:, 3] - at[:, 2]
    n, tall, broad = len(at), int(high.max()), int(wide.max())
    down, along = np.arange(tall)[:, None], np.arange(broad)[:, None]
    # What lies beyond a pair's ranges equals nothing: 0 is no letter, and 1 is none of b's.
    left = np.where(down < high, a[np.minimum(at[:, 0] + down, len(a) - 1)], 1).astype(a.dtype)
    right = np.where(along < wide, b[np.minimum(at[:, 2] + along, len(b) - 1)], 0).astype(b.dtype)
    run = np.zeros((broad + 1, n), np.uint8)  # runs are shorter than FREQUENT_FROM
    size, end_a, end_b = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(tall):
        run[1:] = (run[:-1] + np.uint8(1)) * (right == left[i])
        best = run.max(axis=0)
        more = np.flatnonzero(best > size)
        if len(more):
            size[more], end_a[more] = best[more], at[more, 0] + i + 1
            end_b[more] = at[more, 2] + run[:, more].argmax(axis=0)
    return size.astype(np.int64), end_a, end_b


def _groups(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the pairs, where groups begin): pairs of about the same two lengths are looked at together."""
    step = lambda n: np.ceil(np.log2(n)).astype(np.int64)
    group = step(at[:, 1] - at[:, 0]) * 100 + step(at[:, 3] - at[:, 2])
    order = np.argsort(group, kind="stable")
    return order, np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))


def compare(keys_a: list[str], keys_b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ratio, run) of pairs of keys that are not empty and whose second ones are shorter than FREQUENT_FROM."""
    a, from_a = _codes(keys_a)
    b, from_b = _codes(keys_b)
    a, b = _small(a, b)
    matched, run = np.zeros(len(keys_a), np.int64), np.zeros(len(keys_a), np.int64)
    pair = np.arange(len(keys_a))
    at = np.column_stack([from_a[:-1], from_a[1:], from_b[:-1], from_b[1:]])
    first = True
    while len(pair):
        order, begins = _groups(at)
        pair, at = pair[order], at[order]
        found = []
        for begin, end in zip(begins[:-1], begins[1:]):
            rows = max(1, CELLS // int((at[begin:end, 3] - at[begin:end, 2]).max()))
            found += [_longest(a, b, at[k : min(end, k + rows)]) for k in range(begin, end, rows)]
        size, end_a, end_b = (np.concatenate(x) for x in zip(*found))
        np.add.at(matched, pair, size)
        if first:
            run[pair], first = size, False
        hit = size > 0
        pair, at, size, end_a, end_b = pair[hit], at[hit], size[hit], end_a[hit], end_b[hit]
        left = np.column_stack([at[:, 0], end_a - size, at[:, 2], end_b - size])
        right = np.column_stack([end_a, at[:, 1], end_b, at[:, 3]])
        pair, at = np.concatenate([pair, pair]), np.concatenate([left, right])
        some = (at[:, 1] > at[:, 0]) & (at[:, 3] > at[:, 2])
        pair, at = pair[some], at[some]
    total = np.diff(from_a) + np.diff(from_b)
    return 2.0 * matched / np.maximum(total, 1), run


def ratios_and_runs(keys_a: list[str | None], keys_b: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """`ratio_and_run` of many pairs; equal pairs are compared once."""
    number: dict[tuple, int] = {}
    place = [number.setdefault((x or "", y or ""), len(number)) for x, y in zip(keys_a, keys_b)]
    ratio, run = np.zeros(len(number)), np.zeros(len(number), np.int64)
    pairs = list(number)
    short = [i for i, (x, y) in enumerate(pairs) if x and y and len(y) < FREQUENT_FROM]
    if short:
        ratio[short], run[short] = compare([pairs[i][0] for i in short], [pairs[i][1] for i in short])
    for i, (x, y) in enumerate(pairs):
        if len(y) >= FREQUENT_FROM:
            ratio[i], run[i] = ratio_and_run(x, y)
    return ratio[place], run[place]


@pandas_udf(StructType([StructField("ratio", DoubleType()), StructField("run", IntegerType())]))
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Batches are gathered, as a step over many pairs costs hardly more than one over few."""

    def compared(held: list[tuple[pd.Series, pd.Series]]) -> pd.DataFrame:
        ratio, run = ratios_and_runs(*([x for side in sides for x in side] for sides in zip(*held)))
        return pd.DataFrame({"ratio": ratio, "run": run.astype(np.int32)})

    held: list[tuple[pd.Series, pd.Series]] = []
    for batch in batches:
        held.append(batch)
        if sum(len(x) for x, _ in held) >= PAIRS:
            yield compared(held)
            held = []
    if held:
        yield compared(held)


def longest_run(a: Column, b: Column) -> Column:
    """Longest common substring's length in array functions, for keys of one line."""
    n = F.char_length(a)
    one = lambda i: F.array_max(
        F.filter(F.sequence(F.lit(0), n - i + 1), lambda k: F.contains(b, F.substr(a, i, k)))
    )
    return F.when(n > 0, F.array_max(F.transform(F.sequence(F.lit(1), n), one))).otherwise(0)
