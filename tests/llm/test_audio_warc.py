"""Telephony audio and WARC: known values and round trips."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from strandline.llm import audio as A
from strandline.llm import warc as K


def test_tables():
    u, a = A.mulaw_table(), A.alaw_table()
    # Fixed values of G.711.
    assert [int(u[c]) for c in (0x00, 0x7F, 0x80, 0xFF, 0x8F)] == [-32124, 0, 32124, 0, 16764]
    assert [int(a[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(a.tolist())) == 256


def slow_ima(data, block):
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block]
        if len(b) <= 4:
            continue
        value, index = int.from_bytes(b[:2], "little", signed=True), min(88, b[2])
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(A._STEPS[index])
                move = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(A._INDEX[code])))
                out.append(value)
    return out


def test_ima_across_blocks():
    r = np.random.default_rng(4)
    data = r.integers(0, 256, 64 * 7 + 30, dtype=np.uint8).tobytes()
    rate, pcm = A.expand(A.wav(A.IMA, 8000, data, 64))
    assert rate == 8000 and pcm.tolist() == slow_ima(data, 64)


def test_resample():
    x = np.array([0, 100, -100], "<i2")
    assert A.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert len(A.resample(np.arange(800, dtype="<i2"), 8000, 11025)) == 1102
    # Going down, what the lower rate cannot hold is filtered out, and what it can is kept.
    at = np.arange(4000)
    high, low = (np.rint(8000 * np.sin(2 * np.pi * f * at / 8000)).astype("<i2") for f in (3500, 300))
    assert np.abs(A.resample(high, 8000, 4000)[50:-50]).max() < 300
    assert np.abs(A.resample(low, 8000, 4000)[50:-50] - low[::2][50:-50]).max() < 300


def test_round_trip(spark, tmp_path):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "é" * 100_000), (5, "x" * 64), (5, "x" * 64)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", A.F.lit(1))
    got = {x.doc_id: x for x in A.digests(A.encode(docs)).collect()}
    for i, t in texts:
        data = (t or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(data), len(padded))
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(padded[-64:])
        codes = np.frombuffer(padded, np.uint8)
        pcm = A.resample(A.mulaw_table()[codes], 8000, 16000)
        each = (pcm, A.alaw_table()[codes], np.array(slow_ima(padded[:4096], 64), "<i2") if len(padded) <= 4096 else A.decode_ima(padded, 64))
        assert got[i].feature == "|".join(map(A.features, each))
        assert got[i].pcm_sha256 == hashlib.sha256(A.wav(A.PCM, 16000, pcm.tobytes())).hexdigest()
    assert got[2].feature == got[3].feature
    stored = A.store(A.to_pcm(A.encode(docs)), f"{tmp_path}/media")
    assert {(x.doc_id, x.media, x.pcm) for x in stored.collect()} == {(x.doc_id, x.media, x.pcm) for x in A.to_pcm(A.encode(docs)).collect()}
    pcm = A.to_pcm(A.encode(docs)).where("doc_id = 1").first().pcm
    assert A.read_wav(pcm)[:2] == (A.PCM, 16000)
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [x.pcm for x in A.to_pcm(broken).collect()] == [None, None]
    assert A.digests(A.encode(docs.limit(0))).count() == 0


def test_members_and_parse():
    a, b = K.record(1, "http://x/ y", b"payload", None), K.record(2, "", b"payload", 1)
    data = a + b
    for size in (1, 7, 1 << 16):
        at = [0]

        def read(n, size=size, at=at):
            part = data[at[0] : at[0] + size]
            at[0] += len(part)
            return part

        raws = list(K.members(read))
        assert len(raws) == 2
        head, http, payload = K.parse(raws[0])
        assert payload == b"payload" and head["warc-target-uri"] == "http://x/y" and head["warc-type"] == "response"
        head, http, payload = K.parse(raws[1])
        assert payload == b"" and http["content-length"] == "7" and head["warc-refers-to"] == "<urn:page:1>"
    with pytest.raises(ValueError):
        K.parse(raws[0].replace(b"payload\r\n", b"paxload\r\n"))
    parts = [a[:-3]]
    with pytest.raises(EOFError):
        list(K.members(lambda n: parts.pop() if parts else b""))


def test_archive(spark, tmp_path, monkeypatch):
    big = "<p>" + "z" * 2000
    rows = [(1, "u1", big), (5, "u2", big), (3, None, big), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", "é" * 3000), (None, "u", big), (5, "u2", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", K.F.lit(0)).repartition(3)
    back = K.read(K.write(pages, f"file://{tmp_path}/w")).collect()
    assert len(back) == len(rows)
    text = {i: h for i, _, h in rows}
    for x in back:
        data = (text[x.page_id] or "").encode()
        assert (x.payload_bytes, x.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if data == big.encode() and x.page_id != 5:
            assert (x.record_type, x.refers_to, x.payload) == ("revisit", 5, None)
        else:
            assert (x.record_type, x.refers_to, x.payload) == ("response", None, data)
    assert K.read(K.write(pages.limit(0), f"file://{tmp_path}/e")).count() == 0
    # Archives roll over, and many revisits meet the pages in a shuffle: the same records.
    monkeypatch.setattr(K, "BROADCAST_REVISITS", 0)
    manifest = K.write(pages, f"file://{tmp_path}/r", roll=10)
    assert manifest.count() == len(rows) and {x.records for x in manifest.collect()} == {1}
    assert sorted(map(str, K.read(manifest).collect())) == sorted(map(str, back))
    assert base64.b32decode(K.b32(b"x")[5:]).hex() == hashlib.sha1(b"x").hexdigest()


def plain_features(x):
    """Length, peak, mean square, sign changes, mean square of the differences, mean squares of the quarters; by loops."""
    mean = lambda v: sum(a * a for a in v) // max(1, len(v))
    sizes = [len(x) // 4 + (i < len(x) % 4) for i in range(4)]
    quarters = [x[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(4)]
    steps = [b - a for a, b in zip(x, x[1:])]
    changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    return ":".join(map(str, [len(x), max(map(abs, x)), mean(x), changes, mean(steps), *map(mean, quarters)]))


def plain_mulaw(c):
    c = ~c & 255
    size = (((c & 15) * 2 + 33) << (c >> 4 & 7)) * 4 - 132
    return -size if c & 128 else size


def plain_alaw(c):
    c ^= 0x55
    e, m = c >> 4 & 7, c & 15
    size = (2 * m + 1) * 8 if e == 0 else (2 * m + 33) * 8 << (e - 1)
    return size if c & 128 else -size


def test_features_like_plain_loops(spark, tmp_path):
    """The whole query over a small table: payloads, digests and the features of all three codecs by loops over samples."""
    texts = [(1, "hello world, this is a text " * 9), (2, None), (3, "é😀"), (None, "x" * 64), (5, "".join(map(chr, range(1, 500))))]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("feature", A.F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in A.op3(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        data = (text or "").encode()
        payload = data + b"\0" * (64 * max(1, -(-len(data) // 64)) - len(data))
        u = [plain_mulaw(c) for c in payload]
        doubled = [v for a, b in zip(u, [*u[1:], u[-1]]) for v in (a, (a + b) >> 1)]
        want = "|".join(map(plain_features, (doubled, [plain_alaw(c) for c in payload], slow_ima(payload, 64))))
        x = got[doc_id]
        assert (x.n_bytes, x.payload_bytes, x.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.feature == want


def test_resampled_pcm_is_stored(spark):
    """The query leaves media and PCM in its folder, and its digests are those of the stored PCM."""
    from strandline.sources import folders as D

    r = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 4000):
        pcm = r.integers(-32768, 32768, n).astype("<i2")
        rate, back = A.unpack(A.pack(16000, pcm))
        assert rate == 16000 and back.tolist() == pcm.tolist()
    before = set(D.Folder(spark, A.shared_dir(spark)).names())
    got = {x.doc_id: x for x in A.op3(spark, "/root/testdata/sf0.001").collect()}
    (made,) = (n for n in set(D.Folder(spark, A.shared_dir(spark)).names()) - before if n.startswith("media-"))
    stored = spark.read.parquet(f"{A.shared_dir(spark)}/{made}").collect()
    assert len(stored) == len(got) == 200
    for x in stored:
        rate, pcm = A.unpack(x.packed)
        whole = A.wav(A.PCM, rate, pcm.tobytes())
        assert hashlib.sha256(whole).hexdigest() == got[x.doc_id].pcm_sha256 and len(whole) == got[x.doc_id].pcm_bytes
        assert pcm.tolist() == A.resample(A.expand(x.media)[1], 8000, 16000).tolist()
