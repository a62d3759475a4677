"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import xxhash

from strandline.llm import simhash as H


def plain_fingerprint(text, size=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprint():
    for text in ("", "A", "One two THREE", "a b c d", "x " * 50, "É é\tÀ b\x0bc\nd e", "a\xa0b c d e"):
        assert H.fingerprint(text.encode()) == plain_fingerprint(text)
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    assert H.fingerprint(long.encode()) == plain_fingerprint(long)


def test_components_like_brute_force(spark, monkeypatch):
    r = random.Random(5)
    prints = []
    for _ in range(25):
        p = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 30])):
            prints.append(p)
            for b in r.sample(range(64), r.randint(0, 4)):
                p ^= 1 << b
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long")
    for rows in (4096, 8):  # with 8, hot shards are dealt into chunks
        of = {x.node: x.root for x in H.components(H.links(frame, shard_rows=rows)).collect()}
        label = plain_components(prints)
        want = {}
        for x, l in zip(signed, label):
            want.setdefault(l, set()).add(x)
        got = {}
        for x in set(signed):
            got.setdefault(of.get(x, x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents(spark):
    r = random.Random(1)
    base = [f"w{r.randint(0, 500)}" for _ in range(200)]
    near = base[:]
    near[100] = "other"
    rows = [(5, " ".join(base)), (3, " ".join(base).upper()), (9, " ".join(near)), (7, None), (8, " \n"), (None, "solo text"), (None, " ".join(base)), (3, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", H.F.lit("clash")).withColumn("root", H.F.lit(1))
    got = sorted(((x.doc_id, x.component_id) for x in H.near_duplicates(docs).collect()), key=str)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    near_linked = bin(prints[5] ^ prints[9]).count("1") <= 4
    want = [(5, 3), (3, 3), (3, 3), (9, 3 if near_linked else 9), (7, 7), (8, 7), (None, None), (None, 3)]
    assert got == sorted(want, key=str)
    kept = H.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted([3, 3, 7, None, None], key=str)


def test_empty(spark):
    assert H.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_classes(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def ids_of(rows, label):
    """The component_id of each row: the smallest doc_id of its class."""
    least = {}
    for (doc_id, _), c in zip(rows, label):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    return sorted(((d, least.get(c)) for (d, _), c in zip(rows, label)), key=str)


def test_repeated_ids_are_one_document(spark):
    """Brute force over rows: equal ids link, whatever their texts, and so do near fingerprints."""
    r = random.Random(6)
    text = lambda: " ".join(f"w{r.randint(0, 500)}" for _ in range(30))
    a, b = text(), text()
    rows = [(3, a), (5, a), (5, b), (4, b), (-7, text()), (None, text()), (None, text())]
    rows += [(r.choice([10, 11, 12, 13, None]), text()) for _ in range(12)] + [(None, a)]
    prints = [plain_fingerprint(t) for _, t in rows]
    same = lambda i, j: rows[i][0] == rows[j][0] and rows[i][0] is not None
    label = plain_classes(len(rows), lambda i, j: same(i, j) or bin(prints[i] ^ prints[j]).count("1") <= 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for blocks in (None, 6):
        got = H.near_duplicates(docs, blocks=blocks).collect()
        assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == ids_of(rows, label)
    assert {x.component_id for x in got if x.doc_id in (3, 4, 5)} == {3}


def test_blocks_follow_the_number():
    assert [H.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**11)] == [5, 5, 6, 7]


def test_similar_documents_like_brute_force(spark):
    """Classes of shingle sets; links at 0.8 to 1.0 are found, those below are not made."""
    r = random.Random(12)
    rows, groups = [], 60
    for g in range(groups):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([6, 40, 120, 900]))]
        for _ in range(r.choice([1, 2, 12])):
            own = base[:]
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                own[r.randrange(len(own))] = f"x{r.randint(0, 9999)}"
            rows.append((len(rows), r.choice([str, str.upper])(" ".join(own))))
    rows += [(5000, None), (5001, " "), (5002, "one"), (5003, "ONE"), (5003, "other text of the same id"), (None, rows[0][1]), (None, "alone")]
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] or sets[j] else 1.0
    same = lambda i, j: rows[i][0] == rows[j][0] and rows[i][0] is not None
    pairs = {(i, j): share(i, j) for i in range(len(rows)) for j in range(i) if sets[i] & sets[j] or not (sets[i] or sets[j])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", H.F.lit("clash")).withColumn("n", H.F.lit(1))
    got = H.similar_documents(docs).collect()
    found = sorted(((x.doc_id, x.component_id) for x in got), key=str)
    exact = plain_classes(len(rows), lambda i, j: same(i, j) or pairs.get((i, j), 0) >= 0.8)
    linked = [(i, j) for (i, j), s in pairs.items() if s >= 0.8]
    assert len(linked) > 300 and max(map(len, sets)) > 800
    assert found == ids_of(rows, exact)
    assert H.similar_documents(docs.limit(0)).count() == 0


def test_hot_shards_are_dealt(spark, monkeypatch):
    """One large group of near copies: chunks in pairs give the same class as one tree."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = base[:]
        own[r.randrange(120)] = f"x{i}"
        rows.append((i + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(H, "SET_ROWS", 16)
    assert {x.component_id for x in H.similar_documents(docs).collect()} == {1}


def test_links_of_long_texts_around_the_threshold(spark, monkeypatch):
    """Pairs of 4,000 shingles with similarities of 0.76 to 0.84: none is missed, none is made."""
    r = random.Random(21)
    rows, want = [], {}
    for g in range(60):
        base = [f"g{g}w{r.randint(0, 10**6)}" for _ in range(4004)]
        own = base[:]
        for at in r.sample(range(0, 4000, 7), r.randint(77, 110)):
            own[at] = f"x{r.randint(0, 10**9)}"
        a, b = ({tuple(w[k : k + 5]) for k in range(4000)} for w in (base, own))
        share = len(a & b) / len(a | b)
        if 0.76 <= share <= 0.84:
            rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
            want[2 * g + 1] = 2 * g if share >= 0.8 else 2 * g + 1
    assert len(want) > 40 and 10 < sum(k != v for k, v in want.items()) < len(want) - 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (16 << 20, 20_000):  # all sets of a unit at once, and dealt into chunks by their bytes
        monkeypatch.setattr(H, "SET_BYTES", most)
        got = {x.doc_id: x.component_id for x in H.similar_documents(docs).collect()}
        assert {k: got[k] for k in want} == want and all(got[k - 1] == k - 1 for k in want)
