"""Substring de-duplication against brute force, and the kept index."""

import hashlib
import random
from collections import Counter

import numpy as np

from strandline.llm import substring as S


def brute(rows, every=None, width=13):
    """Rows of the result for `rows`, by the windows of `every` document, or of `rows`."""
    first = {}
    for doc_id, text in every or rows:
        w = (text or "").encode().split()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            key = S.NO_ID if doc_id is None else doc_id
            first[g] = min(first.get(g, key), key)
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        key = S.NO_ID if doc_id is None else doc_id
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    word = lambda: r.choice("abcdefghij") + r.choice("xyz")
    shared = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        own = [word() for _ in range(r.randint(0, 80))]
        at = r.randint(0, len(own))
        if i % 3 == 0:
            own[at:at] = shared.split()[r.randint(0, 20) : r.randint(30, 60)]
        rows.append((i * 7 % 61, r.choice([" ", "\n", "\t "]).join(own)))
    rows += [(None, shared), (None, shared), (3, shared), (3, shared), (900, None), (901, ""), (902, "é " * 40), (903, "é " * 40)]
    return rows


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_TEXT", 600)
    monkeypatch.setattr(S, "HASHED", 200)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", S.F.lit(1)).repartition(5)
    for batches in (1, 2, 3):
        got = S.dedup(docs, shard_windows=500, batches=batches).drop("kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup(docs).count() == 0


def test_kept_text(spark):
    same = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, same), (2, "before " + same + " after")], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in S.dedup(docs, with_text=True).collect()}
    assert kept == {1: same, 2: "before after"}


def test_squeeze_round_trip():
    r = np.random.default_rng(1)
    far = np.sort(np.concatenate([np.arange(100, dtype=np.uint64), np.uint64(1 << 40) + np.arange(5, dtype=np.uint64)]))
    assert (S._expand(S._squeeze(far)) == far).all() and len(S._squeeze(np.zeros(0, np.uint64))) == 5
    for bits in (20, 40, 62):
        key = np.unique(r.integers(0, 1 << bits, 1000, dtype=np.uint64))
        assert (S._expand(S._squeeze(key)) == key).all()
    ids = r.integers(-5, 1 << 40, 3000)
    assert (S._ids_back(S._ids(ids)) == ids).all()


def test_index(spark, tmp_path, monkeypatch):
    """Three batches with a compaction between, each by a new process' eyes: what brute force gives in their order."""
    monkeypatch.setattr(S, "BATCH_TEXT", 600)
    rows = corpus()
    parts = [rows[::3], rows[1::3], rows[2::3]]
    # All of history comes first; within a batch the smaller doc_id. Brute force sees shifted ids.
    shift = lambda i, n: None if i is None else i + 10_000 * n
    seen, folder = [], f"{tmp_path}/index"
    for n, part in enumerate(parts):
        index = S.Index(spark, folder, shards=3)
        assert index.generation == (0, 1, 3)[n] and len(index.parts) == min(n, 1)
        got = index.dedup(spark.createDataFrame(part, "doc_id long, text string")).drop("kept").collect()
        mine = [(shift(i, n), t) for i, t in part]
        every = Counter(brute(seen + mine)) - Counter(brute(seen, seen + mine))
        want = [(None if i is None else i - 10_000 * n, *rest) for i, *rest in every.elements()]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        seen += [(-1 - k if i is None else i, t) for k, (i, t) in enumerate(mine)]
        if n == 1:
            index.compact()
            assert len(index.parts) == 1
    # A copy of what history has loses every word of its windows; a look that is not appended leaves no trace.
    long = next(t for _, t in rows if t and len(t.split()) > 30)
    once = spark.createDataFrame([(0, long), (1, "w " * 5), (2, " ".join(f"new{i}" for i in range(40)))], "doc_id long, text string")
    index = S.Index(spark, folder)
    before = index.generation
    assert {x.doc_id: x.n_removed for x in index.dedup(once, append=False).collect()} == {0: len(long.split()), 1: 0, 2: 0}
    assert S.Index(spark, folder).generation == before


def test_levels(spark, tmp_path):
    """Runs of a level are merged as they come together; what is merged has every window once, in order."""
    r, folder, seen = random.Random(5), f"{tmp_path}/levels", set()
    index = S.Index(spark, folder, shards=2, bits=20, tier=2)
    for n in range(5):
        texts = [" ".join(r.choice("abcd") + r.choice("xy") for _ in range(40)) for _ in range(6)]
        index.append(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
        seen |= {tuple(t.split()[i : i + 13]) for t in texts for i in range(28)}
        assert sorted((n for _, n in index.parts), reverse=True) == [[0], [1], [1, 0], [2], [2, 0]][n]
        entries = [(int(k), int(c)) for p, _ in index.parts for s in (0, 1) for ks, cs in S._segments(p, s) for k, c in zip(ks, cs)]
        assert len(entries) == len(set(entries)) == len(seen)
        for p, _ in index.parts:
            for s in (0, 1):
                keys = [int(k) for ks, _ in S._segments(p, s) for k in ks]
                assert keys == sorted(keys)
    other = S.Index(spark, folder)
    index.append(spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string"))
    try:
        other.append(spark.createDataFrame([(1, "b " * 20)], "doc_id long, text string"))
        raise AssertionError("a second writer went on from an old manifest")
    except RuntimeError as e:
        assert "another writer" in str(e)


def test_table_goes_through_its_index(spark, monkeypatch):
    """Batches of a table are appended one after the other, merged on the way, and no block is moved after it is written."""
    made = []

    class Seen(S.Index):
        def __init__(self, *a, **k):
            super().__init__(*a, **k)
            made.append(self)

        def _merge(self, paths, level):
            self.merged = getattr(self, "merged", 0) + 1
            super()._merge(paths, level)

    monkeypatch.setattr(S, "Index", Seen)
    rows = corpus()
    out = S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), shard_windows=500).drop("kept")
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)
    index = made[0]
    assert S.BATCHES >= 2 and index.generation == S.BATCHES + index.merged and index.merged >= 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "data" in plan
    for part in plan.split("Exchange")[1:]:
        assert "data#" not in part.split("\n")[1], "blocks are shuffled"


def test_merged_runs_and_known_entries(monkeypatch):
    """Runs are merged and looked up segment by segment, equal fingerprints with unequal checks among them."""
    monkeypatch.setattr(S, "SEGMENT", 7)
    r = random.Random(9)
    entries = sorted({(r.randint(0, 60), r.randint(0, 5)) for _ in range(150)})
    own = [[e for e in entries if hash(e) % 3 == i] for i in range(3)] + [[]]
    arrays = lambda es: (np.array([k for k, _ in es], np.uint64), np.array([c for _, c in es], np.uint32))
    made = list(S.merged([S._cut(*arrays(es)) for es in own]))
    assert [(int(k), int(c)) for ks, cs in made for k, c in zip(ks, cs)] == entries and all(len(k) <= 7 for k, _ in made)
    asked = sorted({(r.randint(0, 60), r.randint(0, 5)) for _ in range(150)})
    known = S.known_to(*arrays(asked), S._cut(*arrays(entries)))
    assert known.tolist() == [a in set(entries) for a in asked] and 0 < known.sum() < len(asked)
    assert list(S.merged([])) == [] and not S.known_to(*arrays([]), S._cut(*arrays(entries))).any()


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_polynomials_confuse(spark):
    """The two words of 1,024 letters have equal polynomials modulo 2^64 for any odd factor; no word is shared here."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([f"w{k}" for k in range(12)] + [w])) for i, w in enumerate((one, other), 1)]
    rows += [(3, rows[0][1]), (4, " ".join([one, other] * 10)), (5, " ".join([other, one] * 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.dedup(docs).drop("kept").collect()), key=str) == brute(rows)
    _, first, second = S.word_hashes(f"{one} {other}".encode())
    assert first[0] != first[1] and second[0] != second[1]


def test_equal_fingerprints_remove_nothing(spark, monkeypatch):
    """With fingerprints of 4 bits most windows collide; their checks tell them apart."""
    monkeypatch.setattr(S, "key_bits", lambda words: 4)
    monkeypatch.setattr(S, "BATCH_TEXT", 600)
    rows = corpus()
    got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), shard_windows=500).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_word_hashes():
    texts = [b"", b" ", b"a", b" ab  ba\tab\x0b", "é ü\n".encode() * 3, b"x" * 3000 + b" y", b"a\x85b \xc2\xa0 c"]
    for t in texts:
        start, first, second = S.word_hashes(t)
        words = t.split()
        assert [t[i : i + len(w)] for i, w in zip(start.tolist(), words)] == words and len(start) == len(words)
        for h in (first, second):
            assert len(set(h.tolist())) == len(set(words))
            assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words))
