"""Binary records, Merkle manifest and Lloyd iterations against brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from strandline.llm import lloyd as L
from strandline.llm import merkle as M
from strandline.llm import records as R
from strandline.llm.packing import vocabulary_path


# -- records ------------------------------------------------------------------------------------


def plain_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert R.crc32c([b"123456789"]).tolist() == [0xE3069283]
    r = random.Random(1)
    messages = [r.randbytes(n) for n in [0, 1, 3, 4, 63, 64, 65, 127, 128, 129, 1000, 4096, 5001]] + [b"\0" * 64, b""]
    assert R.crc32c(messages).tolist() == list(map(plain_crc32c, messages))
    assert R.crc32c([]).tolist() == []


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


ROWS = [(5, "Hello, world! Ünïcode 東京 \x1c <|endoftext|>", 1), (2, None, 2), (9, "", 3), (None, "no id", 4), (5, "again five", 5), (7, "a b " * 30_000, 6), (-3, "below zero", 7), (5, "again five", 8)]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids, out, start = plain_ids([r[1] for r in order]), {}, 0
    for r, i in zip(order, ids):
        out.setdefault(r[0], []).append((len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    return out, start


def test_records(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, path long")
    made = R.write(docs, f"file://{tmp_path}/records", roll=2000)
    rows = sorted(R.read(made, with_ids=True).collect(), key=lambda r: r.start)
    want, total = expected(ROWS)
    at, got = 0, {}
    for r in rows:
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert at == total and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert [r.doc_id for r in rows] == [None, -3, 2, 5, 5, 5, 7, 9]
    # Read in another order, by the index: the same records, each from its own place.
    one, two = (R.shuffled(made, seed).collect() for seed in (1, 2))
    key = lambda rs: sorted((r.start, r.n_tokens, r.ids_crc32) for r in rs)
    assert key(one) == key(two) == key(rows)
    assert [r.start for r in one] != [r.start for r in two]


def test_files_are_plain_frames(spark, tmp_path):
    """Any reader of the framing finds length, masked checksum, payload, masked checksum."""
    docs = spark.createDataFrame([(i, "w " * i) for i in range(50)], "doc_id long, text string")
    made = R.write(docs, f"file://{tmp_path}/frames").orderBy("part", "number").collect()
    mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    seen = []
    for f in made:
        data, at = open(f"{f.path[7:]}.rec", "rb").read(), 0
        while at < len(data):
            (n, c), body = struct.unpack_from("<QI", data, at), None
            assert c == mask(plain_crc32c(data[at : at + 8]))
            body = data[at + 12 : at + 12 + n]
            assert struct.unpack_from("<I", data, at + 12 + n)[0] == mask(plain_crc32c(body))
            seen.append(R.unpack(body)[0])
            at += n + 16
    assert seen == list(range(50))


def test_damage_fails(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words here") for i in range(5)], "doc_id long, text string")
    made = R.write(docs.coalesce(1), f"file://{tmp_path}/damaged")
    path = made.first().path[7:] + ".rec"
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="checksum differs"):
        R.read(made).collect()
    open(path, "wb").write(bytes(data[:-3]))
    with pytest.raises(Exception, match="differs|holds"):
        R.read(made).collect()


def test_no_records(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    made = R.write(docs, f"file://{tmp_path}/none")
    assert R.read(made).count() == 0 and R.shuffled(made).count() == 0


# -- Merkle -------------------------------------------------------------------------------------

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves):
    """(root, for each leaf its list of (left, right))."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i // 16 * 16
            paths[k].append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
            at[k] = i // 16
        level = [H("".join(level[a : a + 16])) for a in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof hash) of rows (group, doc_id, leaf)."""
    groups = {}
    for g, i, d in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *plain_tree([d for *_, d in sorted(groups[g])])) for g in names}
    root, over = plain_tree([trees[g][1] for g in names])
    out = []
    for g, beyond in zip(names, over):
        own, sub, paths = trees[g]
        for (known, i, d), p in zip(own, paths):
            out.append((g, i if known else None, d, sub, root, H("".join(a + b for a, b in p + beyond))))
    return out


@pytest.mark.parametrize("local", [1, 2, 3])
def test_manifest(spark, local):
    """Groups of all awkward sizes, over several partitions, against whole trees."""
    r = random.Random(local)
    sizes = {None: 17, "": 1, "a": 16, "b": 257, "é": 300, "hot": 5000, "Z": 15, "z中": 4097, "n": 2}
    rows = [(g, i, H(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    rows += [("b", 5, H("twin")), ("b", 5, H("twin")), ("b", None, H("none")), (None, None, H("x"))]
    rows += [(f"s{i:03d}", i, H(str(i))) for i in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, id long, leaf string")
    made = M.manifest(df, M.F.col("g"), M.F.col("id"), M.F.col("leaf"), local=local)
    got = made.select("name", "id", "leaf", "root", "top", M.proof_digest(M.F.col("path")), M.folded(M.F.col("path"), M.F.col("leaf")).alias("f")).collect()
    assert sorted(map(str, (tuple(x[:6]) for x in got))) == sorted(map(str, plain_manifest(rows)))
    assert all(x.f == x.top for x in got)


def test_tampering_and_fields(spark, tmp_path):
    rows = [(i, "s", None, i, "Text É" if i % 2 else None) for i in range(40)] + [(None, None, "en", None, "AB"), (7, "s", None, 7, "Text É")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", M.F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op13(spark, str(tmp_path)).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {(i, t): H("".join(map(field, (i, s, lang, n, t)))) for i, s, lang, n, t in rows}
    assert sorted(x.leaf for x in got) == sorted(leaf[r[0], r[4]] for r in rows)
    for x in got:
        text = "Text É" if x.doc_id is not None and x.doc_id % 2 else "AB" if x.doc_id is None else None
        bad = x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0 and text is not None
        assert x.verified == (not bad) == (x.folded_root == x.root)


def test_manifest_of_little(spark):
    empty = spark.createDataFrame([], "g string, id long, leaf string")
    assert M.manifest(empty, M.F.col("g"), M.F.col("id"), M.F.col("leaf")).count() == 0
    one = spark.createDataFrame([(None, None, H("x"))], "g string, id long, leaf string")
    x = M.manifest(one, M.F.col("g"), M.F.col("id"), M.F.col("leaf")).first()
    assert (x.leaf, x.root, x.top, x.path, x["name"]) == (H("x"), H("x"), H("x"), [], None)


# -- Lloyd --------------------------------------------------------------------------------------


def plain_lloyd(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, label, whole numbers): codes, errors and codebook with everything recomputed in every round."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    w = len(rows[0][2]) // parts
    cut = [[[int(x) for x in v[p * w : (p + 1) * w]] for p in range(parts)] for *_, v in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        code = [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, k in zip(cut, code) if k[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for (i, label, _), c, k in zip(rows, cut, code):
        out.append((i, label, "".join(f"{e:02x}" for e in k), sum(dist(c[p], books[p][k[p]]) for p in range(parts))))
    return out, books


def run(df, column="embedding"):
    model = L.Lloyd(df, column)
    for _ in range(L.ROUNDS):
        model.round()
    return model, [tuple(x) for x in model.codes().collect()]


def test_lloyd(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(0, 0.3, (300, 20)).astype(np.float32)  # 20 numbers: filled up to 24
    vectors[40:60] = vectors[0]  # ties
    rows = [(int(i) * 7 % 300 if i % 50 else None, None if i % 9 == 0 else i % 4, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(1, 1, None), (2, 1, []), (3, 1, [0.1] * 19 + [None]), (4, 1, [0.1] * 19 + [float("nan")]), (5, 1, [float("-inf")] * 20), (400, 1, [0.5] * 7)]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>").withColumn("block", L.F.lit(1)).repartition(5)
    want, books = plain_lloyd([(i, None if k is None else str(k), np.concatenate([np.floor(4096 * np.array(v, np.float64)), np.zeros(4)])) for i, k, v in rows])
    model, got = run(df)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert model.codebook.tolist() == [[list(map(int, e)) for e in b] for b in books]
    # The running sums are those of the last round's assignment, and later rounds send less than the first.
    assert all(sum(c) == 300 for c in model.counts)
    sent = [model.assignments(i).selectExpr("sum(size(delta))").first()[0] for i in (1, 6)]
    assert sent[1] < sent[0]
    label = {r[0]: r[1] for r in L.with_label_error(model.codes()).groupBy("label").agg(L.F.first("label_error")).collect()}
    for k in {w[1] for w in want}:
        assert label[k] == sum(w[3] for w in want if w[1] == k)


def test_previous_assignments_move_nothing(spark):
    """The join of a round has no exchange below it: both sides are bucketed by block."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 0, r.normal(0, 1, 16).tolist()) for i in range(64)], "vec_id long, label int, embedding array<double>")
    model = L.Lloyd(df)
    model.round()
    rows = model.blocks().join(model.assignments(1).select("block", "codes").hint("shuffle_hash"), "block")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan


def test_lloyd_of_little(spark):
    empty = spark.createDataFrame([(1, 0, None)], "vec_id long, label int, embedding array<float>")
    model = L.Lloyd(empty)
    assert model.empty and model.codes().count() == 0
    three = spark.createDataFrame([(1, None, [9e9] * 8), (2, 0, [-0.00001] * 8), (2, 0, [0.25] * 8)], "vec_id long, label int, embedding array<double>")
    model, got = run(three)
    # Of the two rows of one id, the one whose bytes come first is the earlier entry.
    want = [(1, None, "00" * 8, 0), (2, "0", "02" * 8, 0), (2, "0", "01" * 8, 0)]
    assert model.entries == 3 and sorted(map(str, got)) == sorted(map(str, want))
    assert model.codebook[0].tolist() == [[1 << 25], [1024], [-1]]


def test_exact_distances():
    """Beyond 53 bits distances are still exact, and equal ones go to the lower index."""
    x = np.array([[1 << 25, -(1 << 25)], [0, 1]], np.int64)
    e = np.array([[(1 << 25) - 1, -(1 << 25)], [1 << 25, -(1 << 25) + 1], [0, 0], [0, 0]], np.int64)
    assert L.nearest(x, e).tolist() == [0, 2]
