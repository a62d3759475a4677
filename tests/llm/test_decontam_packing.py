"""Decontamination and packing against brute force."""

import random
import zlib

import numpy as np

from strandline.llm import decontam as D
from strandline.llm import packing as P


def slow_align(item, text):
    m, n = len(item), len(text)
    h = [[0] * (n + 1) for _ in range(m + 1)]
    best = 0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            s = D.MATCH if item[i - 1] == text[j - 1] else D.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - D.GAP, h[i][j - 1] - D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment():
    r = random.Random(7)
    for _ in range(200):
        a = np.array([r.randint(0, 5) for _ in range(r.randint(1, 12))])
        b = np.array([r.randint(0, 5) for _ in range(r.randint(1, 30))])
        score, start, end = D.align(a, b)
        assert score == slow_align(a.tolist(), b.tolist())
        assert score == slow_align(a.tolist(), b[start:end].tolist())


def words(r, n, salt=""):
    return [f"{salt}{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.randint(0, 400)}" for _ in range(n)]


def test_contaminated(spark):
    r = random.Random(1)
    items = [(i, " ".join(words(r, 30, "q"))) for i in range(6)] + [(6, "tiny item"), (7, None), (8, "..."), (0, "again " * 5)]
    edited = items[1][1].split()
    for i in (4, 11, 18, 25):
        edited[i] = "changed"
    del edited[14]
    clean = lambda n: " ".join(words(r, n))
    rows = [
        (1, clean(50) + " " + items[0][1].upper().replace(" ", ", ") + " " + clean(50)),
        (2, clean(5000) + " " + " ".join(edited)),
        (3, clean(3000)), (4, None), (5, ""), (None, items[2][1]), (6, "a tiny item here"),
        (7, " ".join(items[3][1].split()[:8]) + " " + clean(40)),
    ]
    rows += [(100 + i, clean(20) + " " + items[4][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", D.F.lit(1))
    got = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(x.doc_id, x.item_id) for x in got}
    assert pairs == {(1, 0), (2, 1), (None, 2), (6, 6)} | {(100 + i, 4) for i in range(40)}
    by = {(x.doc_id, x.item_id): x for x in got}
    assert by[1, 0].score == 1.0 and (by[1, 0].start_word, by[1, 0].end_word) == (50, 80)
    assert 0.5 < by[2, 1].score < 1
    assert D.contaminated(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert D.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_copies_in_many_documents(spark):
    """An edited copy and a half copy are found however many documents hold them."""
    r = random.Random(11)
    items = [(i, " ".join(words(r, 30, "q"))) for i in range(4)]
    edited = lambda i: [w if j not in (4, 11, 18, 25) else "changed" for j, w in enumerate(items[i][1].split()) if j != 14]
    passages = [(0, edited(0), 3), (1, edited(1), 1000), (2, items[2][1].split()[:16], 3), (3, items[3][1].split()[:16], 1000)]
    rows, want = [], set()
    for item, passage, copies in passages:
        for _ in range(copies):
            want.add((len(rows), item))
            rows.append((len(rows), " ".join(words(r, 20) + passage + words(r, 20))))
    rows += [(5000 + i, " ".join(words(r, 60) + items[2][1].split()[:8])) for i in range(50)]
    got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    r = random.Random(2)
    items = [(i, " ".join(words(r, 12, "q"))) for i in range(3)]
    docs = spark.createDataFrame([(i, "x " + t) for i, t in items], "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(0, 0), (1, 1), (2, 2)}


def test_recall_of_edited_copies(spark):
    """All pairs that whole Smith-Waterman accepts, by the share of words that are edited, whatever the number of copies."""
    r = random.Random(21)
    items = [(i, words(r, r.choice([5, 8, 20, 40]), "q")) for i in range(24)]
    rows, copies_of = [], {}
    for i, own in items:
        share = (0.0, 0.1, 0.2, 0.3)[i % 4]
        passage = []
        for w in own:
            kind = r.choice(["change", "drop", "insert"]) if r.random() < share else "keep"
            passage += {"keep": [w], "change": ["x" + w], "drop": [], "insert": [w, "y" + w]}[kind]
        for _ in range((1, 3, 10, 100)[i // 4 % 4]):
            copies_of[len(rows)] = i
            rows.append((len(rows), " ".join(words(r, 15) + passage + words(r, 15))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in D.contaminated(docs, bench).collect()}
    want = {}
    for doc_id, text in rows:
        for i, own in items:
            number = {w: k for k, w in enumerate(own)}
            score = slow_align([number[w] for w in own], [number.get(w, -1) for w in text.split()]) / (D.MATCH * len(own))
            if score >= D.THRESHOLD:
                want[doc_id, i] = score
    assert got.keys() <= want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    recall = len(got) / len(want)
    assert len(want) > 300 and recall >= 0.97, recall
    # A document is found or not whatever the number of copies.
    for i, _ in items:
        mine = [d for d, k in copies_of.items() if k == i]
        assert len({(d, i) in got for d in mine}) == 1


def test_frequent_seeds_lose_nothing(monkeypatch):
    """Whatever counts as rare, the same items are found with the same scores: in texts of items and their parts."""
    r = random.Random(31)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 20])))) for i in range(300)]
    texts = []
    for _ in range(150):
        own = r.choice(items)[1].split()
        part = [w if r.random() > 0.2 else r.choice(vocabulary) for w in own]
        texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randint(0, 30))] + part + ["other"] * 5))
    found = []
    for rare in (0, 3, 64, 10**6):
        aligner = D.Aligner(D.Seeds(items, D.N, rare=rare))
        found.append([D.matches(aligner, t, D.THRESHOLD) for t in texts])
    assert found[0] == found[1] == found[2] == found[3] and sum(map(len, found[0])) > 300


def test_a_common_pair_of_many_items():
    """50,000 short items share a pair that a long document says over and over; two of them are in it."""
    import time

    r = random.Random(32)
    own = lambda i: [f"a{i}x{k}" for k in range(4)] + ["common", "pair"] + [f"b{i}x{k}" for k in range(4)]
    items = [(i, " ".join(own(i))) for i in range(50_000)]
    aligner = D.Aligner(D.Seeds(items, D.N))
    text = []
    for i in range(500):
        text += ["common", "pair"] + [f"z{r.randint(0, 3000)}" for _ in range(18)]
    text[300:300] = own(77)
    text[4000:4000] = own(40_000)[2:9]
    t = time.perf_counter()
    got = D.matches(aligner, " ".join(text), D.THRESHOLD)
    assert time.perf_counter() - t < 5
    assert [(x[0], x[1]) for x in got] == [(77, 1.0), (40_000, 0.7)]


ODD = ["ΑΣ ΣΑΣ. İstanbul", "it's I'LL can't. don't,x", "a\x1cb  c d　e", "x́ 한국어 12a3 ½ ǅ", "<|endoftext|> <|x|", "", "..,, |a| a| ||", "ﬀ ŉ ß ẞ", "a​b ﻿"]


def test_encoder(monkeypatch):
    from tokenizers import Tokenizer

    e, plain = P.Encoder(P.vocabulary_path()), Tokenizer.from_file(P.vocabulary_path())
    r = random.Random(3)
    texts = ODD + ["hello <|endoftext|> world", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|> <|endoftext"] + [" ".join(words(r, 200)) for _ in range(5)]
    for bound in (600_000, 50):
        monkeypatch.setattr(P, "REMEMBERED", bound)
        e.known.clear(), e.known_parts.clear()
        for _ in range(2):
            for t, ids in zip(texts, e.encode(texts)):
                assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def slow_sum_of_squares(sizes, capacity):
    gaps, bins = [], 0
    for s in sizes:
        count = lambda g: 0 if g in (0, capacity) else gaps.count(g)
        options = [(2 * (count(g - s) - count(g)) + 2 if g > s else 1 - 2 * count(s), g) for g in set(gaps) if g >= s]
        new = 0 if s == capacity else 2 * count(capacity - s) + 1
        best = min(options, default=None)
        if best and s < capacity and best[0] <= new:
            gaps.remove(best[1])
            gaps.append(best[1] - s)
        else:
            bins += 1
            gaps.append(capacity - s)
        gaps = [g for g in gaps if g]
    return bins


def test_sum_of_squares():
    r = random.Random(4)
    for _ in range(30):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 60))]
        seq, off = P.pack_sizes(sizes, 20)
        assert int(seq.max()) + 1 == slow_sum_of_squares(sorted(sizes, reverse=True), 20)
        for q in set(seq.tolist()):
            mine = sorted((o, s) for o, s, x in zip(off.tolist(), sizes, seq.tolist()) if x == q)
            assert [o for o, _ in mine] == np.cumsum([0] + [s for _, s in mine])[:-1].tolist() and sum(s for _, s in mine) <= 20


def best_fit(sizes, capacity):
    """Sequences that decreasing best fit makes."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return len(gaps)


def test_a_new_sequence_only_for_what_fits_nowhere():
    """Beyond the free ones: among open sequences the rule is the same, and the packing is as good as best fit's."""
    r = random.Random(6)
    for free in (0, 5):
        p, gaps = P.Packer(30, free), []
        for _ in range(300):
            size = r.randint(1, 20)
            opened = p.next
            p.place(size)
            if p.next > opened >= free:
                assert all(g < size for g in gaps)
            gaps = [g for g in range(1, 30) for _ in range(p.count[g])]
    sizes = [min(2048, max(1, int(r.lognormvariate(6.5, 0.9)))) for _ in range(3000)]
    bound = -(-sum(sizes) // 2048)
    made = int(P.pack_sizes(sizes, 2048, P.FREE * bound)[0].max()) + 1
    assert made <= best_fit(sizes, 2048) + 1


def test_fewest_sequences(spark):
    """Over the whole table of documents, as few sequences as there can be."""
    got = P.op6(spark, "/root/testdata/sf0.01")
    n, total = got.select(P.F.count_distinct("sequence_id"), P.F.sum("length")).first()
    assert n == -(-total // 2048)


def test_no_task_gets_more_than_its_share(spark, monkeypatch):
    """Pieces that nothing can be put beside, and pieces of all sizes: rounds of at most `task_pieces` a task."""
    seen, round_ = [], P._round
    monkeypatch.setattr(P, "_round", lambda cut, tasks, *a: (seen.append((cut.count(), tasks)), round_(cut, tasks, *a))[1])
    r = random.Random(7)
    kinds = {"alone": lambda: 1500, "wide": lambda: r.randint(1100, 2030), "mixed": lambda: min(2048, max(1, int(r.lognormvariate(6.8, 0.7))))}
    for name, size in kinds.items():
        for n in (2000, 8000):
            seen.clear()
            rows = [(i, 0, 0, size(), 0) for i in range(n)]
            cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
            got = P.pack(cut, task_pieces=500).toPandas()
            assert len(got) == n and got.doc_id.is_unique and got.groupby("sequence_id").length.sum().max() <= 2048
            assert all(rows <= 500 * tasks for rows, tasks in seen), seen
            made = got.sequence_id.nunique()
            if name == "mixed":
                assert made <= 1.02 * -(-got.length.sum() // 2048)
            else:
                assert made == n and len(seen) == 1


def test_pack(spark):
    r = random.Random(5)
    rows = [(i, " ".join(words(r, r.choice([0, 3, 60, 300])))) for i in range(90)] + [(None, None), (5, "same"), (5, "same"), (99, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", P.F.lit(1))
    for task_pieces in (50_000, 10):
        got = P.pack(P.pieces(docs), task_pieces=task_pieces).toPandas()
        assert got.length.max() <= 2048
        total = got.groupby("sequence_id").length.sum()
        assert total.max() <= 2048
        g = got.sort_values(["sequence_id", "offset"])
        assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
        fewest = best_fit(got.length.tolist(), 2048)
        assert len(total) <= fewest + 1
    e = P.Encoder(P.vocabulary_path())
    ids = np.array(e.whole.encode("long " * 5000, add_special_tokens=False).ids + [0], "<u4")
    mine = got[got.doc_id == 99].sort_values("piece")
    assert mine.length.sum() == len(ids) and mine.start.tolist() == [0, 2048, 4096]
    for p in mine.itertuples():
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert P.pack(P.pieces(docs.limit(0))).count() == 0
