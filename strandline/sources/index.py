"""A stored inverted index of corpus lines, added to by work, in a folder that all machines share.

A run is what one `add` brought: the lines, sorted by work, and three kinds of postings (k, work_id, line_idx), sorted by key:

* `heads`: the first letters of a line's key;
* `grams`: every `MIN_LETTERS` letters that follow each other in it;
* `pairs`: every two neighbouring folded words of its text;

and of each kind how many lines have a key. Postings are laid out by a checksum of the key (a partition of the folder) and sorted within
it, so that a search reads the partitions, row groups and pages of its keys alone. Runs are never changed; a manifest, a file a
generation, names those that count. It is created exclusively, so of two writers that add at the same time one starts again from what
the other has added. A failed `add` leaves files that no manifest names. `compact` makes one run of all.

`hits` looks each query up by the rarest of its keys, as counted; a key that no line has ends a search at once. The lines of the places
found are then read by their works. The keys and places of a few queries, as of a micro-batch, are looked up one scan after the other, each
with what the one before found as its filter; more are joined.

A work that the index has already is left as it is. Works without lines are not known to it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .. import config as C
from ..functions import text as T
from ..operators.retrieve import grams, word_pairs
from .folders import Folder

LINE = "work_id long, line_idx int, line_id long, source string, text string, letters string"
POSTING = "k string, work_id long, line_idx int, b int"
KINDS = ("heads", "grams", "pairs")
#: Works up to this number are a filter of a scan; so many keys of queries, or places found, are held; keys up to the last number, at most
#: some 30 MB, are broadcast.
FEW, HELD, BROADCAST_KEYS = 1_000, 10_000, 1_000_000
#: Values of one pushed-down list; longer lists are pushed as a range. So many lists at most, as each is evaluated for each row.
_LIST, _LISTS = 10, 5


def any_of(column: str, values: list) -> Column:
    """A filter that Parquet's statistics and dictionaries can answer for each of some values, and for the range of more."""
    step = _LIST if len(values) <= _LIST * _LISTS else len(values)
    lists = [F.col(column).isin(values[i : i + step]) for i in range(0, len(values), step or 1)]
    return reduce(Column.__or__, lists) if lists else F.lit(False)


def few(df: DataFrame, column: str) -> list | None:
    """The distinct values of a column, if there are few."""
    found = df.select(column).distinct().limit(FEW + 1).collect()
    return sorted(r[0] for r in found if r[0] is not None) if len(found) <= FEW else None


class StoredIndex:
    def __init__(self, spark: SparkSession, folder: str, script: T.Script = T.LATIN, buckets: int = 16):
        """A new index, or the one that the folder has, with its own script and number of partitions."""
        self.spark, self.folder, self.script, self.buckets = spark, folder, script, buckets
        self.generation, self.runs = 0, []
        self.refresh()

    # -- the manifest ---------------------------------------------------------------------------

    def refresh(self) -> None:
        """Read the last manifest: what other processes have added since."""
        files = Folder(self.spark, f"{self.folder}/manifest")
        for name in sorted((n for n in files.names() if n.endswith(".json")), reverse=True):
            try:
                last = json.loads(files.read(name))
            except ValueError:  # being written
                continue
            if last["script"] != self.script.name:
                raise ValueError(f"the index is of script {last['script']}")
            self.generation, self.runs, self.buckets = last["generation"], last["runs"], last["buckets"]
            return

    def _commit(self, runs: list[str]) -> bool:
        """Name the runs that count, as the next generation; False if another writer has made one since."""
        now = {"generation": self.generation + 1, "runs": runs, "buckets": self.buckets, "script": self.script.name}
        if not Folder(self.spark, f"{self.folder}/manifest").create(f"{now['generation']:012d}.json", json.dumps(now)):
            return False
        self.generation, self.runs = now["generation"], runs
        return True

    # -- writing --------------------------------------------------------------------------------

    def add(self, lines: DataFrame) -> int:
        """Add the lines (LINE) of works that the index has not; how many generations it has now."""
        names = [c.split()[0] for c in LINE.split(", ")]
        lines = lines.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LINE.split(", ")]).select(*names)
        while True:
            new = lines.join(self.works(), "work_id", "left_anti") if self.runs else lines
            run = self._write(new.select(*names))
            if self._commit([*self.runs, run]):
                return self.generation
            # The other writer may have added some of these works.
            self.refresh()

    def compact(self) -> None:
        """One run of all; searches that go on keep reading the old ones."""
        while len(self.runs) > 1:
            if self._commit([self._write(self.lines())]):
                return
            self.refresh()

    def _write(self, lines: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        where = f"{self.folder}/{run}"
        by = ("work_id", "line_idx")
        lines.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{where}/lines")
        stored = self.spark.read.schema(LINE).parquet(f"{where}/lines")
        for kind in KINDS:
            k = F.explode(self.keys(kind, F.col("letters"), F.col("text"))).alias("k")
            postings = stored.select(k, *by).withColumn("b", self._bucket(F.col("k")))
            # Ranges of whole postings: a key that most lines have is many ranges.
            order = ("b", "k", *by)
            postings.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("b").parquet(f"{where}/{kind}")
            counted = self._read(f"{where}/{kind}", POSTING).groupBy("b", "k").agg(F.count("*").alias("n"))
            counted.repartitionByRange("b", "k").sortWithinPartitions("b", "k").write.partitionBy("b").parquet(f"{where}/{kind}_n")
        return run

    def keys(self, kind: str, letters: Column, text: Column) -> Column:
        """Keys of a line, or of a query: what a line must have to hold it."""
        if kind == "heads":
            return F.filter(F.array(F.left(letters, F.lit(C.MIN_LETTERS))), lambda k: F.char_length(k) == C.MIN_LETTERS)
        return grams(letters, C.MIN_LETTERS) if kind == "grams" else word_pairs(T.script_fold(text, self.script))

    # -- reading --------------------------------------------------------------------------------

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _table(self, name: str, schema: str) -> DataFrame:
        # Run by run, as the partitions of a folder are named by its own path.
        runs = [self._read(f"{self.folder}/{run}/{name}", schema) for run in self.runs]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], schema)

    def lines(self) -> DataFrame:
        return self._table("lines", LINE)

    def works(self) -> DataFrame:
        return self.lines().select("work_id").distinct()

    def postings(self, kind: str) -> DataFrame:
        return self._table(kind, POSTING)

    def lines_of(self, works: DataFrame) -> DataFrame:
        """The lines of some works (work_id), read by row groups where these are few."""
        ids = few(works, "work_id")
        if ids is not None:
            return self.lines().where(any_of("work_id", ids))
        return self.lines().join(works.select("work_id").distinct(), "work_id", "left_semi")

    def _bucket(self, k: Column) -> Column:
        return F.pmod(F.crc32(k.cast("binary")), F.lit(self.buckets)).cast("int")

    def _with(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The rows of a table by key with one of few keys, read by partition and key."""
        if not keys:
            return rows.where("false")
        buckets = sorted({zlib.crc32(k.encode()) % self.buckets for k in keys})
        return rows.where(F.col("b").isin(buckets) & any_of("k", keys))

    def _of(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows of a table by key whose key is among `keys`."""
        values = few(keys, "k")
        if values is not None:
            return self._with(rows, values)
        asked = keys.select("k").distinct()
        small = asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        return rows.join(F.broadcast(asked), "k", "left_semi") if small else rows

    def _counts(self, kind: str) -> DataFrame:
        return self._table(f"{kind}_n", "k string, n long, b int")

    def hits(self, kind: str, queries: DataFrame) -> DataFrame:
        """(the columns of `queries`, the line's): lines with the rarest of each query's keys, of queries (qid, keys, ...)."""
        asked = queries.select("qid", F.explode(F.array_distinct("keys")).alias("k"))
        rows = asked.limit(HELD + 1).collect()
        if len(rows) <= HELD:
            places, works = self._few_places(kind, [tuple(r) for r in rows], queries.schema["qid"])
        else:
            counted = self._of(self._counts(kind), asked).groupBy("k").agg(F.sum("n").alias("n"))
            by = asked.join(counted, "k", "left").groupBy("qid")
            rare = by.agg(F.min_by("k", F.struct("n", "k")).alias("k"), F.count_if(F.col("n").isNull()).alias("unknown"))
            rare = rare.where("unknown = 0").select("qid", "k")
            places, works = self._of(self.postings(kind), rare).join(rare, "k").select("qid", "work_id", "line_idx"), None
        lines = self.lines_of(places) if works is None else self.lines().where(any_of("work_id", works))
        found = lines.join(places, ["work_id", "line_idx"])
        return found.join(queries.drop("keys"), "qid")

    def _few_places(self, kind: str, asked: list[tuple], qid: StructField) -> tuple[DataFrame, list[int] | None]:
        """(qid, work_id, line_idx) of a few keys (qid, k), and the works, if these are few."""
        counts = self._with(self._counts(kind), sorted({k for _, k in asked})).groupBy("k").agg(F.sum("n")).collect()
        n, keys = dict(map(tuple, counts)), {}
        for q, k in asked:
            keys.setdefault(q, []).append(k)
        rare = {q: min(own, key=lambda k: (n[k], k)) for q, own in keys.items() if all(k in n for k in own)}
        having: dict[str, list] = {}
        for q, k in rare.items():
            having.setdefault(k, []).append(q)
        postings = self._with(self.postings(kind), sorted(having)).select("k", "work_id", "line_idx")
        schema = StructType([qid, StructField("k", StringType())])
        if sum(n[k] * len(qs) for k, qs in having.items()) > HELD:
            asked_ = self.spark.createDataFrame(list(rare.items()), schema)
            return postings.join(asked_, "k").select("qid", "work_id", "line_idx"), None
        schema = StructType([qid, StructField("work_id", LongType()), StructField("line_idx", IntegerType())])
        found = [(q, w, i) for k, w, i in postings.collect() for q in having[k]]
        works = sorted({w for _, w, _ in found})
        return self.spark.createDataFrame(found, schema), works if len(works) <= FEW else None
