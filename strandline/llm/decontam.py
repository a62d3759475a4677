"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. A seed is an n-gram of a benchmark item's words. Rare seeds, which at most
`rare` items have, lead to their items at once. A frequent seed leads only to those of its items of which the
document holds a rare word as well: an alignment that counts leaves at most m - t of an item's m words unmatched (t is the
least number of matches that reaches the threshold), so it matches one of the m - t + 1 rarest. This loses nothing, so what is found in
a document depends neither on the other documents nor on what is rare. Each place where a seed of an item occurs in a document opens a window of twice the item's length on both sides, as
no alignment that counts is longer; overlapping windows of the same item join. The item is aligned with
each window by Smith-Waterman (match +2, mismatch -1, gap -1), and a document is contaminated by an item
whose best score reaches `threshold` of the score of an exact copy.

Seeds have `n` words, those of items under `short` words two, and items of fewer words are one seed. So a copy
with some three quarters of its words left nearly always has a seed; one that is edited at least at every
third word (second, of short items) throughout has none and is not found.

Common phrases are kept cheap without a loss: no score exceeds a match for each word that the item shares
with the document, or with the window, repeats counted, so what stays below the threshold by this
is not aligned; and a task aligns equal windows once.

The seeds are a sorted table of hashes with the items of each, some 20 bytes a word. It goes to the tasks in
blocks of at most `block_items` items and `block_chars` characters, which bounds it to some 60 MB, and is
joined there with the hashes of the documents' n-grams: one pass over the corpus per block, and no shuffle of
it. Equal hashes of different words only open a window for nothing.

Defined cases: null or empty texts, and items without words, match nothing; items with equal words are
all reported; of equal scores the leftmost alignment is reported; null ids are kept in reports; rows that
repeat a doc_id are reported each; texts are searched whole; an empty corpus or benchmark gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_or_empty, without_ids

N, SHORT, THRESHOLD, RARE = 3, 12, 0.5, 64
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 16_000_000
#: Words whose hashes, and bytes of windows whose alignments, a task remembers.
REMEMBERED_WORDS, REMEMBERED = 100_000, 8_000_000
MATCH, MISMATCH, GAP = 2, -1, 1

_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, of no further meaning


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Words:
    """Hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        new = set(words).difference(known)  # a view of the keys would be gone through whole
        if new:
            if len(known) > REMEMBERED_WORDS:
                known.clear()
                new = set(words)
            digest = xxhash.xxh64_intdigest
            known.update((w, digest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of words' hashes, one for each place where n words begin."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = (total ^ (total >> np.uint64(31))) * _P + hashes[i : i + len(total)]
    return total


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of two arrays of word numbers, in `text`, end exclusive."""
    m = len(text)
    row, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    step = GAP * np.arange(m + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(text == word, MATCH, MISMATCH)
        up = row[1:] - GAP
        take = diagonal >= up
        new, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
        new[1:] = np.maximum(np.where(take, diagonal, up), 0)
        origin[1:] = np.where(new[1:] > 0, np.where(take, begin[:-1], begin[1:]), origin[1:])
        # A gap in the text: the best of all cells to the left, less its distance.
        reach = np.maximum.accumulate(new + step)
        source = np.maximum.accumulate(np.where(new + step == reach, np.arange(m + 1), 0))
        new, origin = reach - step, origin[source]
        row, begin = new, origin
        top = int(new.argmax())
        if new[top] > best[0]:
            best = (int(new[top]), int(origin[top]), top)
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), text_or_empty()).toLocalIterator()
    for item_id, text in rows:
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    if block:
        yield block


class Seeds:
    """The n-grams of a block of items by their hashes, and which items have them."""

    def __init__(self, items: list[tuple[int, str]], n: int, short: int = SHORT, threshold: float = THRESHOLD, rare: int = RARE):
        words, self.rare = Words(), rare
        self.ids = [i for i, _ in items]
        self.words = [words.hashes(words_of(t)) for _, t in items]
        self.distinct = [np.unique(w) for w in self.words]
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, own in enumerate(self.words):
            size = min(len(own), n if len(own) >= short else 2)
            if size:
                by_size.setdefault(size, []).append((np.unique(grams(own, size)), k))
        #: size -> hashes in order, where the owners of each begin, and the owners.
        self.tables = {size: self._table(parts) for size, parts in by_size.items()}
        frequent = [owner[np.repeat(np.diff(first) > rare, np.diff(first))] for _, first, owner in self.tables.values()]
        #: The rarest words of the items that have frequent seeds, in the same form.
        self.rarest = self._rarest(np.unique(np.concatenate(frequent)) if frequent else np.zeros(0, np.int32), threshold)

    @staticmethod
    def _table(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in parts)])
        owner = np.repeat([k for _, k in parts], [len(g) for g, _ in parts]).astype(np.int32)
        order = np.argsort(key, kind="stable")
        distinct, first = np.unique(key[order], return_index=True)
        return distinct, np.append(first, len(key)), owner[order]

    def _rarest(self, items: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, first, _ = self._table([(self.distinct[k], k) for k in items.tolist()])
        having, parts = np.diff(first), []
        for k in items.tolist():
            own = self.words[k]
            count = having[np.searchsorted(word, own)]
            most = len(own) - int(np.ceil(threshold * len(own))) + 1
            parts.append((np.unique(own[np.lexsort((own, count))[:most]]), k))
        return self._table(parts)

    @staticmethod
    def _find(key: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes that a sorted table has, where it has them)."""
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
        hit = np.flatnonzero(key[at] == hashes)
        return hit, at[hit]

    @staticmethod
    def _owners(first: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owners of the entries `at`, which entry each is of)."""
        count = first[at + 1] - first[at]
        of = np.repeat(np.arange(len(at)), count)
        return owner[first[at][of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]], of

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of the seeds in a sequence of hashes, by item."""
        items, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        some = None
        for size, (key, first, owner) in self.tables.items():
            hit, at = self._find(key, grams(hashes, size))
            rare = first[at + 1] - first[at] <= self.rare
            found, of = self._owners(first, owner, at[rare])
            items.append(found)
            places.append(hit[rare][of])
            often = at[~rare]
            if len(often) and some is None:
                key_, first_, owner_ = self.rarest
                some = np.unique(self._owners(first_, owner_, self._find(key_, np.unique(hashes))[1])[0])
            for g in np.unique(often).tolist():
                # The owners of a seed are in order.
                mine = np.intersect1d(owner[first[g] : first[g + 1]], some, assume_unique=True)
                here = hit[~rare][often == g]
                items.append(np.repeat(mine, len(here)))
                places.append(np.tile(here, len(mine)))
        item, place = np.concatenate(items), np.concatenate(places)
        order = np.argsort(item, kind="stable")
        return item[order], place[order]


def windows(places: list[int], reach: int, total: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in sorted(places):
        a, b = max(0, p - reach), min(total, p + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


class Aligner:
    """Aligns items with windows; equal windows of an item once."""

    def __init__(self, seeds: Seeds):
        self.seeds, self.words = seeds, Words()
        self.coded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.known: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        self.held = 0

    def code(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Numbers of an item's words in a sequence of hashes, -1 for others."""
        own = self.seeds.distinct[k]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return np.where(own[at] == hashes, at, -1)

    def score(self, k: int, text: np.ndarray, threshold: float) -> tuple[int, int, int]:
        """`align` of item k with numbered words; score 0 where it cannot reach the threshold."""
        if k not in self.coded:
            coded = self.code(k, self.seeds.words[k])
            self.coded[k] = coded, np.bincount(coded)
        item, count = self.coded[k]
        shared = np.minimum(count, np.bincount(text + 1, minlength=len(count) + 1)[1:]).sum()
        if shared < threshold * len(item):
            return 0, 0, 0
        key = k, text.tobytes()
        if key not in self.known:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[key] = align(item, text)
            self.held += len(key[1])
        return self.known[key]


def matches(aligner: Aligner, text: str, threshold: float) -> list[tuple]:
    """(item_id, score, start word, end word, item words) of the items found in a text."""
    seeds = aligner.seeds
    hashes = aligner.words.hashes(words_of(text))
    items, places = seeds.places(hashes)
    if not len(items):
        return []
    present, out = np.unique(hashes), []
    head = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
    for k, low, high in zip(items[head].tolist(), head.tolist(), np.append(head, len(items))[1:].tolist()):
        m, own = len(seeds.words[k]), seeds.distinct[k]
        # Each word that the item has twice may match twice.
        if len(seeds._find(present, own)[0]) + m - len(own) < threshold * m:
            continue
        best = (0, 0, 0)
        for a, b in windows(places[low:high].tolist(), 2 * m, len(hashes)):
            coded = aligner.code(k, hashes[a:b])
            if np.count_nonzero(coded >= 0) < threshold * m:
                continue
            score, s, e = aligner.score(k, coded, threshold)
            if score > best[0]:
                best = (score, a + s, a + e)
        share = best[0] / (MATCH * m)
        if share >= threshold:
            out.append((seeds.ids[k], share, best[1], best[2], m))
    return out


_OUT = "doc_id long, item_id long, score double, start_word int, end_word int, item_words int"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int32()),
        ("end_word", pa.int32()), ("item_words", pa.int32()),
    ]
)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and benchmark item that it holds a copy, or an edited copy, of."""
    spark = prepare(docs.sparkSession)
    found = None
    for items in _blocks(benchmark):
        seeds = Seeds(items, n, threshold=threshold)
        if not seeds.tables:
            continue
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            aligner = Aligner(shared.value)
            for batch in batches:
                rows = [
                    (doc_id, *hit)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for hit in matches(aligner, text, threshold)
                ]
                columns = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA
                )

        part = docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, _OUT)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], _OUT) if found is None else found


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; documents without an id stay."""
    return without_ids(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))
