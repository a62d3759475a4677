"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

A document's tokens are its text's ids and a closing id. Documents longer than a sequence are cut into
full pieces and a last, possibly shorter one; nothing else is cut. Each piece goes where the sum of the
squared numbers of open sequences per residual gap becomes smallest.

That is so until half of the sequences that the tokens need at least are open; from then on a new one is opened only
for a piece that fits in none.

Pieces are dealt evenly over tasks of at most `task_pieces` pieces, each of which packs its own, the largest first (state: one counter per
gap). A sequence less than `full` filled may go round again, dealt anew over as many tasks as such pieces need, but only if one of all
such pieces fits into its gap, or its own smallest piece into the largest of their gaps; else no round could change it. This is decided
by two numbers over all of them. Rounds end with one task, or when a round has not settled a tenth of its pieces. So no task
ever gets more than `task_pieces` pieces, whatever their sizes and number; with more than one task a few sequences more than
the fewest may be made.

Defined cases: null and empty texts are the closing id alone; repeated rows are packed each on its own;
null doc_id is kept; the strings of the vocabulary's added tokens become these tokens, as its own encoder has
it; of equally good gaps the smallest is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_or_empty

CAPACITY, CLOSING, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Pieces that one task packs in the first round, and the share of a sequence that counts as full.
TASK_PIECES, FULL = 50_000, 0.995
#: The share of the sequences needed at least up to which a new one may be opened though a piece fits in an open one.
FREE = 0.5
#: Words, and parts of words, whose ids a worker remembers; those it met first.
REMEMBERED = 400_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts by a vocabulary file, as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern never crosses white space, so a text's ids are those of its words one after
    the other, and a worker remembers the ids of words it has met. New words are normalised and split
    here by the file's own rules and go through its merges together; the marked last token of each part
    tells which ids belong to which word.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        raw = json.load(open(path))
        self.whole = Tokenizer.from_file(path)
        # Texts with the string of an added token, or with white space of another kind, go through it whole.
        odd = [t["content"] for t in raw.get("added_tokens", ())] + list("\x1c\x1d\x1e\x1f")
        self.odd = regex.compile("|".join(map(regex.escape, odd)))
        split = raw["pre_tokenizer"]["pretokenizers"][0]
        self.parts = regex.compile(split["pattern"]["Regex"])
        suffix = raw["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 + max(raw["model"]["vocab"].values()), bool)
        self.ends[[i for w, i in raw["model"]["vocab"].items() if w.endswith(suffix)]] = True
        plain = Tokenizer(self.whole.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.plain = plain
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def split(self, word: str) -> list[str]:
        """A word's parts after the vocabulary's normalisation: NFC, and lower case character by character."""
        w = word if word.isascii() else unicodedata.normalize("NFC", word)
        w = w.lower() if "\u03a3" not in w else "".join(map(str.lower, w))
        if w.isalpha():
            return [w]
        if w[-1] in ".,|" and w[:-1].isalpha():
            return [w[:-1], w[-1]]
        return self.parts.findall(w)

    def learn_parts(self, parts: list[str]) -> dict[str, bytes]:
        ids = np.array(self.plain.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        end = (4 * np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])).tolist()
        if len(end) != len(parts) + 1:  # an unusual character: one by one
            return {p: np.array(self.plain.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in parts}
        data = ids.tobytes()
        return {p: data[a:b] for p, a, b in zip(parts, end, end[1:])}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, which hold no white space."""
        split = list(map(self.split, words))
        new = list({p for own in split for p in own}.difference(self.known_parts))
        now = self.learn_parts(new) if new else {}
        if len(self.known_parts) + len(now) <= REMEMBERED:
            self.known_parts.update(now)
            return {w: b"".join(map(self.known_parts.__getitem__, own)) for w, own in zip(words, split)}
        known = self.known_parts
        return {w: b"".join([known[p] if p in known else now[p] for p in own]) for w, own in zip(words, split)}

    def encode(self, texts: list[str]) -> list[bytes]:
        # Four control characters are white space to str.split() but not to the vocabulary's pattern.
        words = [None if self.odd.search(t) else t.split() for t in texts]
        new = {w for ws in words if ws for w in ws}.difference(self.known)
        now = self.learn(list(new)) if new else {}
        if len(self.known) + len(now) <= REMEMBERED:
            self.known.update(now)
            joined = [b"".join(map(self.known.__getitem__, ws)) if ws else b"" for ws in words]
        else:
            self.known.update(list(now.items())[: max(0, REMEMBERED - len(self.known))])
            known = self.known
            joined = [b"".join([known[w] if w in known else now[w] for w in ws or ()]) for ws in words]
        for i, ws in enumerate(words):
            if ws is None:
                joined[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return joined


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and the ids themselves if asked for."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or vocabulary_path())
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                data += closing
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(schema)])
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
            )

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, ddl)


class Packer:
    """Online sum-of-squares packing. Once `free` sequences are open, a new one is opened only for what fits in none."""

    def __init__(self, capacity: int, free: float = float("inf")):
        self.capacity, self.free = capacity, free
        self.count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; gaps 0 and capacity don't count
        self.open: dict[int, list[int]] = defaultdict(list)
        self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        if size == self.capacity:
            self.next += 1
            return self.next - 1, 0
        count, room = self.count, self.capacity - size
        # Moving a sequence from gap g to g - size changes the sum by 2 (count[g - size] - count[g]) + 2.
        change = 2 * (count[:room] - count[size : self.capacity]) + 2
        change[0] = 1 - 2 * count[size]  # closes a sequence
        change[count[size : self.capacity] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if room else 0
        fits = room and change[best] < np.iinfo(np.int64).max
        if fits and (change[best] <= 2 * count[room] + 1 or self.next >= self.free):
            gap = best + size
            sequence = self.open[gap].pop()
            count[gap] -= 1
        else:
            gap, sequence = self.capacity, self.next
            self.next += 1
        if gap > size:
            count[gap - size] += 1
            self.open[gap - size].append(sequence)
        return sequence, self.capacity - gap


def pack_sizes(sizes: list[int], capacity: int, free: float = float("inf")) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, the largest placed first."""
    packer = Packer(capacity, free)
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        sequence[i], offset[i] = packer.place(sizes[i])
    return sequence, offset


def _round(cut: DataFrame, tasks: int, capacity: int, number: int) -> DataFrame:
    """Pack each task's pieces; `gap` is what their sequence has left, `least` its smallest piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole = pa.Table.from_batches(list(batches))
        if not len(whole):
            return
        sizes = np.array(whole.column("length").to_pylist(), np.int64)
        sequence, offset = pack_sizes(sizes.tolist(), capacity, FREE * sizes.sum() / capacity)
        gap = capacity - np.bincount(sequence, weights=sizes).astype(np.int64)
        least = np.full(len(gap), capacity, np.int64)
        np.minimum.at(least, sequence, sizes)
        first = (number << 56) | (TaskContext.get().partitionId() << 32)
        columns = [*whole.columns[:5], *map(pa.array, (first + sequence, offset, gap[sequence], least[sequence]))]
        names = [*whole.column_names[:5], "sequence_id", "offset", "gap", "least"]
        yield from pa.Table.from_arrays(columns, names).combine_chunks().to_batches(max_chunksize=10_000)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap long, least long"
    return cut.repartition(tasks).mapInArrow(run, ddl).checkpoint()


def pack(cut: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES, full: float = FULL) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    prepare(cut.sparkSession)
    cut = cut.checkpoint()
    left, done, number = cut.count(), [], 0
    more = ("gap", "least", "sequence_id", "offset")
    while left:
        tasks = -(-left // task_pieces)
        packed = _round(cut, tasks, capacity, number)
        # What may still change: in one task nothing does.
        loose = F.col("gap") > (1 - full) * capacity if tasks > 1 else F.lit(False)
        edge = packed.where(loose).agg(F.min("least"), F.max("gap")).first()
        loose = loose & ((F.col("gap") >= F.lit(edge[0])) | (F.col("least") <= F.lit(edge[1]))) if edge[0] is not None else F.lit(False)
        before, left = left, packed.where(loose).count()
        if left > 0.9 * before:
            left, loose = 0, F.lit(False)
        done.append(packed.where(~loose).drop("gap", "least"))
        cut, number = packed.where(loose).drop(*more), number + 1
    out = done[0] if done else cut.selectExpr("*", "0L AS sequence_id", "0L AS offset")
    for rows in done[1:]:
        out = out.union(rows)
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs))
