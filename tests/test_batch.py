"""Whole sessions in batch: what the steps send and what they leave on disk and in memory."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import retrieve as R
from strandline.queries import QUERIES
from strandline.streaming import batch

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_")}


def left_behind(spark, make):
    """(shuffle files, kept RDDs) that are there after a query's steps and were not before."""
    rdds = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    files, kept = shuffle_files(spark), rdds()
    df = make()
    for _ in range(40):  # files are removed in the background
        if not shuffle_files(spark) - files:
            break
        time.sleep(0.5)
    return df, shuffle_files(spark) - files, rdds() - kept


def test_track_fold_leaves_one_step_on_disk(spark):
    """Before, what all steps had shuffled lay on disk together, beside what was kept."""
    df, files, kept = left_behind(spark, lambda: QUERIES["track_fold"](spark, SF))
    assert not files and not kept and df.count() > 0


@pytest.mark.parametrize("name", ["work_records", "silence_autolock", "hyp_evidence"])
def test_other_queries_keep_nothing(spark, name):
    """Before, what was kept stayed, with the files of all steps behind it."""
    df, files, kept = left_behind(spark, lambda: QUERIES[name](spark, SF))
    assert not files and not kept and df.columns


def test_commands_are_made_once(spark):
    """Before, they were made for the works that they name and for the fold again, from the whole replay."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(arg):
        read.add(1)
        return arg

    said = spark.createDataFrame([(1, i, False, t) for i, t in enumerate(["ab cd ef gh", "ij kl mn op"])], "session long, window_idx long, silent boolean, text string")
    windows = said.withColumn("letters", T.first_letters(F.col("text")))
    lines = windows.select(F.lit(5).cast("long").alias("work_id"), F.col("window_idx").cast("int").alias("line_idx"), F.lit("s").alias("source"), "text", "letters")
    told = spark.createDataFrame([(1, 1, "manual_select", "5")], "session long, window_idx long, command string, arg string").repartition(2)
    found = batch.events(windows, lines, told.withColumn("arg", seen.asNondeterministic()("arg"))).where("type = 'locked'").collect()
    assert read.value == 1 and {x.work_id for x in found} == {5}


@pytest.mark.parametrize("both", [False, True])
def test_places_like_lines(spark, both):
    """The slim cascade finds what the cascade over whole lines finds, by the same lines, with works that come twice and lines without a key."""
    rng = random.Random(11)
    vocab = ["ab", "ba", "cab", "bad", "dab", "abba", "é"]
    said = [(w % 40, i, rng.choice(["G", "s", None]), " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 8, 12])))) for w in range(44) for i in range(4)]
    lines = spark.createDataFrame(said, "work_id long, line_idx int, source string, text string").withColumn("letters", T.first_letters(F.col("text")))
    lines = lines.union(spark.createDataFrame([(99, 0, None, None, None), (98, 0, "s", "ab ba cab bad", None)], lines.schema)).repartition(3)
    queries = [(i, said[rng.randrange(len(said))][3] + rng.choice(["", " dab", " ba ab"]), rng.random() < 0.5) for i in range(60)]
    queries = spark.createDataFrame(queries, "qid long, text string, start boolean").withColumn("letters", T.first_letters(F.col("text")))
    want = R.cascades(queries, lines, (False, True) if both else (False,)).withColumn("line", F.hash("source", "text", "letters"))
    got = R.cascade_places(R.asked(queries, both), lines)
    once = F.col("work_id").between(4, 97)  # the order of lines of one place is open
    columns = ["qid", "start", "work_id", "line_idx", "line", "tags"]
    assert sorted(map(str, got.where(once).select(columns).collect())) == sorted(map(str, want.where(once).select(columns).collect()))
    columns = ["qid", "start", "work_id", "place"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and got.count() > 150


def test_places_are_limited_in_the_task(spark):
    """Of a common stretch a task sends no more than a strategy keeps, and never the text; before, every line that has it was sent, whole."""
    lines = spark.range(0, 1000, 1, 2).select(
        F.col("id").alias("work_id"), F.lit(0).alias("line_idx"), F.lit("s").alias("source"), F.lit("ab cd ef gh ij").alias("text"), F.lit("acegi").alias("letters")
    )
    queries = spark.createDataFrame([(1, "acegi", "ab cd ef gh ij", False)], "qid long, letters string, text string, start boolean")
    asked = R.asked(queries, False).localCheckpoint()
    plan = R.cascade_places(asked, lines)._jdf.queryExecution().executedPlan().toString()
    assert any("WindowGroupLimit" in x and "Partial" in x for x in plan.splitlines()) and R.cascade_places(asked, lines).count() == 10


def candidate(work, score, overlap=2):
    return {"work_id": work, "score": score, "overlap": overlap}


def test_rivals_leave_out_what_another_always_precedes():
    s = batch.Rivals()
    meet = lambda *lists, block=0: sorted(s.meet(block, list(lists), 0.7, 1))
    # 2 never came before 1, and 9 has too few words; the sixth is no hypothesis.
    assert meet([candidate(1, 0.9), candidate(2, 0.9), candidate(9, 0.8, 0), candidate(4, 0.3), candidate(5, 0.3), candidate(6, 0.9)]) == [1]
    # Now 2 did, but not before it was enough for a lock; 1 is given once a block.
    assert meet([candidate(2, 0.5), candidate(1, 0.4)]) == []
    assert meet([candidate(1, 0.9), candidate(2, 0.8)]) == [2]
    assert meet([candidate(1, 0.9), candidate(2, 0.8)], block=1) == [1, 2]
    # Both lists count; what is no hypothesis precedes nothing.
    assert meet([candidate(1, 0.9), candidate(7, 0.8)], [candidate(7, 0.8)], block=2) == [1, 7]
    assert meet([candidate(-1, 0.9), candidate(8, 0.8)], block=3) == [-1, 8]
