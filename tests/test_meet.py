"""What many queries ask meets the lines in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import meet as M
from strandline.operators import retrieve as R

LINE = "work_id long, line_idx int, source string, text string, letters string"


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(5)
    out = []
    for w in range(60):
        for i in range(rng.randint(1, 5)):
            words = [rng.choice(["ab", "ba", "a", "bab", "é", "abba"]) for _ in range(rng.choice([0, 1, 3, 9, 30]))]
            out.append((w, i, rng.choice(["G", "s", None]), rng.choice([" ", ", ", "  "]).join(words), "".join(rng.choice("abਸ𝄞") for _ in range(rng.choice([0, 2, 5, 25])))))
    return out + [(70, 0, None, None, None), (71, 0, "s", "", "")]


@pytest.mark.parametrize("asked_at_once", [M.ASKED, 60])
def test_meeting_like_brute_force(spark, lines, monkeypatch, asked_at_once):
    """Beginnings, letters anywhere and phrases of all lengths, in one pass and in several."""
    rng = random.Random(6)
    monkeypatch.setattr(M, "ASKED", asked_at_once)
    monkeypatch.setattr(M, "CHARS", 200)
    keys = [k for *_, k in lines if k and len(k) >= 3]
    folds = [" ".join(t.replace(",", " ").split()) for *_, t, _ in lines if t]
    asks = set()
    for _ in range(80):
        k, f = rng.choice(keys), rng.choice([f for f in folds if " " in f]).split()
        i, n = rng.randint(0, len(k) - 3), rng.randint(3, 25)
        asks |= {(M.PREFIX, k[:n]), (M.INSIDE, k[i : i + n]), (M.INSIDE, k[i : i + n] + "a")}
        i = rng.randint(0, len(f) - 2)
        asks |= {(M.PHRASE, " ".join(f[i : i + rng.randint(2, 10)]))}
    asked = spark.createDataFrame(sorted(asks), "kind int, ask string").withColumn("k", M.key("ask", "kind"))
    corpus = spark.createDataFrame(lines, LINE).repartition(3)
    met = M.meeting(corpus, T.script_fold(F.col("text"), T.LATIN), asked).join(asked, "k").collect()
    got = {(r.kind, r.ask, r.work_id, r.line_idx) for r in met}
    want = set()
    for kind, ask in asks:
        for w, i, _, t, k in lines:
            fold = " " + " ".join((t or "").replace(",", " ").split()) + " "
            holds = {M.PREFIX: (k or "").startswith(ask), M.INSIDE: ask in (k or ""), M.PHRASE: f" {ask} " in fold}[kind]
            want |= {(kind, ask, w, i)} if holds else set()
    assert got == want and len(want) > 300


def test_cascade_reads_the_lines_once(spark, lines, tmp_path):
    """All strategies go through the lines together; before, each read them anew, the regular expressions of all lines included."""
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lines")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    corpus = spark.read.parquet(f"{tmp_path}/lines").withColumn("text", seen.asNondeterministic()("text"))
    queries = spark.createDataFrame([(1, "abaabb", "ab ba ab bab ab"), (2, "bbb", "a ab"), (3, "zzzzzz", "")], "qid long, letters string, text string")
    R.cascade(queries, corpus).collect()
    assert read.value == len(lines)


def test_batch_events_like_rows_without_an_index(spark):
    """Whole sessions in batch give the events that the rows of a stream give, over more windows than one block, with repeats and commands; no
    query of the tracker makes an index of the corpus."""
    from strandline.plans import match_queries as Q
    from strandline.queries import QUERIES
    from strandline.streaming import batch, run

    rng = random.Random(7)
    vocab = ["river", "stone", "amber", "light", "garden", "ocean", "valley", "under", "every", "nested", "quiet", "bright"]
    said = [(w, i, "src1" if w % 2 else "G", " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 12)))) for w in range(8) for i in range(6)]
    corpus = spark.createDataFrame(said, "work_id long, line_idx int, source string, text string").withColumn("letters", T.first_letters(F.col("text")))
    windows = []
    for session in (1, 2):
        for i in range(70):
            silent = rng.random() < 0.15
            windows.append((session, i, silent, "" if silent else said[(i // 7 * 6 + rng.randint(0, 5)) % len(said)][3]))
    windows = run.clean(spark.createDataFrame(windows, "session long, window_idx long, silent boolean, text string"))
    told = [(1, 3, "manual_select", "5"), (1, 9, "force_unlock", None), (2, 66, "recall", "1"), (2, 20, "manual_select", "99"), (2, 30, "set_confidence_mode", "fast")]
    told = spark.createDataFrame(told, "session long, window_idx long, command string, arg string")
    for commands in (None, told):
        want = sorted(map(tuple, run.track(run.rows(windows, corpus, commands)).collect()), key=str)
        got = sorted(map(tuple, batch.events(windows, corpus, commands).collect()), key=str)
        assert got == want and {"locked", "navigate", "switched"} <= {e[3] for e in got}
    sf = "/root/testdata/././sf0.001"
    assert QUERIES["track_fold"](spark, sf).count() > 0
    assert not [key for key in Q._stored if key[1] == sf]
