"""Text, score and signal functions against hand-derived cases."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from strandline import config as C
from strandline.functions import score as S
from strandline.functions import signal as G
from strandline.functions import text as T
from strandline.functions.similarity import longest_run, ratio_and_run, similarity


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, letters",
    [
        ("ਸੋਚੈ ਸੋਚਿ ਨ ਹੋਵਈ ਜੇ ਸੋਚੀ ਲਖ ਵਾਰ", "ਸਸਨਹਜਸਲਵ"),
        ("सोचै सोचि न होवई", "ਸਸਨਹ"),
        ("ਆਦਿ ਇਕ ਈਸ਼ ਏਕ ਐਸਾ ਉਸ ਊਚ ਔਰ", "ਅੲੲੲੲੳੳੳ"),
        ("hello ਨਾਨਕ, 123 ਿਸ", "ਨਸ"),
        ("", ""),
    ],
)
def test_first_letters(spark, text, letters):
    assert one(spark, T.first_letters(F.lit(text), T.INDIC)) == letters


def test_corpus_key_differs_from_query_key(spark):
    # A digit or a carrier counts in a corpus line, and only the first character is looked at.
    assert one(spark, T.first_letters_corpus(F.lit("੧ ੳ (ਸ ਿਸ"), T.INDIC)) == "੧ੳਿ"
    assert one(spark, T.first_letters(F.lit("੧ ੳ (ਸ ਿਸ"), T.INDIC)) == "ਸਸ"


def test_script_fold(spark):
    assert one(spark, T.script_fold(F.lit("hi ਨਾਨਕ, नानक 12"))) == "ਨਾਨਕ ਨਾਨਕ"


@pytest.mark.parametrize(
    "text, good",
    [
        ("ਵਾਹਿਗੁਰੂ ਜੀ", True), ("a", False), ("...", False), ("rrrrr", False), ("please like this", False), ("中文 ab", False),
        ("ॐ ਸਤਿ ਨਾਮ", False), ("Music playing", False), ("ab ab ab ab", False), ("good words", True), ("1234", False), ("   x  ", False),
    ],
)
def test_garbage(spark, text, good):
    assert one(spark, T.is_valid(F.lit(text))) is good


def test_phrases(spark):
    words = " ".join(f"w{c}" for c in "abcdefghijkl")
    got = one(spark, T.phrases(F.lit(words)))
    w = words.split()
    assert got == [" ".join(w[:10]), " ".join(w[:4]), " ".join(w[-4:]), " ".join(w[4:8])]
    assert one(spark, T.phrases(F.lit(words), True)) == [" ".join(w[:6]), " ".join(w[:4]), " ".join(w[-4:])]
    assert one(spark, T.phrases(F.lit("aa bb"))) == ["aa bb"] and one(spark, T.phrases(F.lit("a bb"))) == []


def test_dedup_words(spark):
    assert one(spark, T.dedup_words(F.lit("a a b  b a"))) == "a b a"


def test_similarity(spark):
    pairs = [("abcd", "bcde"), ("", "a"), ("ab" * 60, "ba" * 120), ("abc", "abc")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    rows = frame.select("a", "b", similarity("a", "b").alias("s"), longest_run(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        ratio, run = ratio_and_run(r.a, r.b)
        assert (r.s.ratio, r.s.run) == (ratio, run)
        if r.a and len(r.b) < 200:
            assert ratio == SequenceMatcher(None, r.a, r.b).ratio() and r.n == run


def test_scores(spark):
    exact = S.context_free(F.lit(1.0), F.lit(4), F.lit("abcd"), F.lit("abcd"), F.lit("G"))
    assert round(one(spark, exact), 3) == 0.9
    assert one(spark, S.context_free(F.lit(1.0), F.lit(4), F.lit(""), F.lit("abcd"), F.lit("G"))) == 0.0
    assert one(spark, S.classify(F.lit(0.75))) == "auto" and one(spark, S.classify(F.lit(0.59))) == "ignore"
    # An exact match sums to just under 0.90 and reaches the switch level only when rounded.
    assert one(spark, S.instant_switch(F.round(exact, 3), F.lit(0.5), F.lit(1))) is True
    bias = {d: one(spark, S.progression(F.lit(5 + d), F.lit(5), F.lit(0.5))) for d in (-5, -1, 0, 1, 2, 3, 9)}
    assert {d: round(x, 2) for d, x in bias.items()} == {-5: 0.38, -1: 0.46, 0: 0.62, 1: 0.66, 2: 0.6, 3: 0.44, 9: 0.42}
    assert one(spark, S.progression(F.lit(9), F.lit(0), F.lit(0.88))) == 0.88


def test_signal(spark):
    x = F.array(F.lit(0.3), F.lit(-0.4))
    assert round(one(spark, G.rms(x)), 6) == round((0.125) ** 0.5, 6)
    assert one(spark, G.has_voice(F.array().cast("array<double>"))) is False
    assert [round(v, 6) for v in one(spark, G.auto_gain(x))] == [0.525, -0.7]
    assert one(spark, G.auto_gain(F.array(F.lit(0.001)))) == [0.001]
    assert one(spark, G.tail_slice(x, 1)) == [-0.4] and len(one(spark, G.tail_slice(x, 5))) == 2


def test_profiles():
    assert C.profile("fast").lock_windows == 1 and C.profile("odd") is C.BALANCED and C.profile(None) is C.BALANCED


def test_similarity_of_many_pairs():
    """The array operations give what the standard library's matcher gives, pair by pair; SQL gives it too."""
    import duckdb

    from strandline.functions.similarity import ratio_and_run, ratios_and_runs
    from strandline.plans.match_queries import SIMILAR

    r = random.Random(1)
    word = lambda k, n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzà"[:k]) for _ in range(n))
    pairs = {("", "abc"), ("abc", ""), ("", ""), ("aaa", "aaaa"), ("abcabc", "abc"), ("a", "a")}
    pairs |= {(word(k, r.randint(0, 20)), word(k, r.randint(0, 30))) for k in (2, 5, 26) for _ in range(400)}
    for _ in range(80):  # long keys, whose frequent letters begin no match
        b = word(r.choice([5, 26]), r.choice([199, 200, 230, 400]))
        b = b[:50] + "zqjx" + b[50:] if r.random() < 0.5 else b
        at = r.choice([0, r.randint(0, len(b) - 12)])
        pairs.add((b[at : at + 12] + word(26, 3), b))
    ordered = sorted(pairs)
    want = [ratio_and_run(*p) for p in ordered]
    ratio, run = ratios_and_runs([a for a, _ in ordered] + [None], [b for _, b in ordered] + ["x"])
    assert ratio.tolist() == [x for x, _ in want] + [0.0] and run.tolist() == [x for _, x in want] + [0]
    some = [p for p in ordered if p[0] and p[1] and (len(p[1]) > 100 or r.random() < 0.3)]
    c = duckdb.connect()
    c.execute("CREATE TABLE pairs (qa VARCHAR, lb VARCHAR)")
    c.executemany("INSERT INTO pairs VALUES (?, ?)", some)
    got = {(a, b): (x, y) for a, b, x, y in c.sql("WITH RECURSIVE " + SIMILAR + " SELECT qa, lb, ratio, run FROM sim").fetchall()}
    for p in some:
        x, y = ratio_and_run(*p)
        assert abs(got[p][0] - x) < 1e-12 and got[p][1] == y


def test_time_is_linear(spark):
    """Expressions over all words, pairs or samples of a row take time in proportion to its length."""
    import time

    from strandline.functions import signal as G
    from strandline.operators.retrieve import bigrams

    spark.range(10).selectExpr("1").collect()
    text = spark.createDataFrame([(n, " ".join(f"w{i % 977}" for i in range(n))) for n in (30_000,)], "n long, text string")
    block = spark.createDataFrame([([0.01 * (i % 50) for i in range(160_000)],)], "x array<double>")
    t = time.perf_counter()
    text.select(F.size(F.split(T.dedup_words(F.col("text")), " ")), F.size(bigrams(F.col("text"))), T.is_valid(F.col("text"))).collect()
    block.select(G.peak(G.auto_gain(F.col("x")))).collect()
    assert time.perf_counter() - t < 20  # quadratic forms take minutes


def test_pairs_of_unequal_lengths_are_compared_in_few_steps(monkeypatch):
    """A long key among many short ones does not make all of them as many steps (and cells) as it has letters."""
    from strandline.functions import similarity as S_

    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    pairs = [(key(6), key(6)) for _ in range(3000)] + [(key(199), key(199))]
    cells, longest = [], S_._longest

    def counted(a, b, at):
        cells.append(len(at) * int((at[:, 1] - at[:, 0]).max()) * int((at[:, 3] - at[:, 2]).max()))
        return longest(a, b, at)

    monkeypatch.setattr(S_, "_longest", counted)
    ratio, run = S_.ratios_and_runs(*zip(*pairs))
    assert list(zip(ratio, run)) == [S_.ratio_and_run(x, y) for x, y in pairs]
    # 3,000 x 36 cells and 199 x 199, twice that for the rests; one frame for all took 3,000 x 199 x 199.
    assert sum(cells) < 1_000_000
