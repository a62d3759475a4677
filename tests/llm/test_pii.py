"""Personal data: spans against the plain patterns, disclosure, redaction."""

import hashlib
import math
import random
import re
import string
from collections import Counter

from strandline.llm import pii as P


def plain(text):
    """The contract's patterns, used directly."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and P.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_spans_like_patterns():
    r = random.Random(2)
    texts = ["a@b@c.d", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x1.2.3.4", "999.1.1.1", "+1 (234) 567-8901", "4111-1111 1111 1111", "é@b.c", "a@b..c", "@b.c", "١٢.1.1.1.1"]
    texts += ["".join(r.choice("ab1234.@-+ ()é%") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice("0123456789 -") for _ in range(r.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert [x[:3] for x in P.base_spans(t)] == plain(t), t


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000):
        P.base_spans(t)


def test_query_shape_and_disclosure(spark):
    # "nickname" stands beside one address in several different texts and nowhere else.
    rows = [(i, f"filler{i} talk about zorro42 joe@mail.example.com today number {i}") for i in range(6)]
    rows += [(100 + i, f"plain words today number {i} talk about things") for i in range(60)]
    rows += [(200, None), (None, ""), (201, "joe@mail.example.com alone"), (201, "joe@mail.example.com alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", P.F.lit(1)).withColumn("near", P.F.lit(2))
    got = {x.doc_id: x for x in P.find(docs).collect()}
    one = got[0]
    at = rows[0][1].index("joe@")
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 0, 0, 0)
    assert one.base_sha256 == hashlib.sha256(f"email:{at}:{at + 20}".encode()).hexdigest()
    z = rows[0][1].index("zorro42")
    assert f"term:{z}:{z + 7}" in one.spans.split(",") and "email" in one.spans
    assert got[200].spans == "" and got[100].spans == ""
    assert got[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {x.doc_id: x for x in P.sanitise(docs.withColumn("n_chars", P.F.lit(5).cast("long"))).collect()}
    assert "zorro42" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[100].text == rows[6][1] and clean[200].text is None
    assert P.find(docs.limit(0)).count() == 0


def test_terms_joined_when_too_many(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("b",), ("c",), ("zz",)], "term string")
    for bound in (10, 1):
        monkeypatch.setattr(P, "TERM_SET", bound)
        assert {tuple(x) for x in P.term_counts(docs, terms).collect()} == {("b", 2), ("c", 2)}


def test_long_words_do_not_shorten_the_context(spark):
    url = "https://example.org/" + "x" * 500
    text = f"zorro42 {url} joe@mail.example.com {url} nickname77"
    assert [x[1] for x in P.contexts(text, P.base_spans(text))] == ["zorro42", url, url, "nickname77"]
    text = " ".join(f"w{i}ab" for i in range(20)) + " (joe@mail.example.com), " + " ".join(f"v{i}ab" for i in range(20))
    assert [x[1] for x in P.contexts(text, P.base_spans(text))] == [f"w{i}ab" for i in range(13, 20)] + [f"v{i}ab" for i in range(7)]
    rows = [(i, f"filler{i} zorro42 {url} joe@mail.example.com") for i in range(4)] + [(9, "joe@mail.example.com")]
    docs = spark.createDataFrame(rows + [(20 + i, f"plain{i}") for i in range(20)], "doc_id long, text string")
    told = P.disclosures(docs, P.detect(docs)).where("term = 'zorro42'").first()
    assert (told.n_pair, told.n_entity) == (4, 5)


def slow_disclosures(rows):
    """(entity, term) -> (n_pair, n_term, n_entity, support) by the definitions, document by document."""
    pair, term, entity = {}, Counter(), Counter()
    core = lambda w: w[0].strip(string.punctuation).lower()
    for _, text in rows:
        text = text or ""
        spans, rest = plain(text), list(text)
        for s, _, e in spans:
            rest[s:e] = " " * (e - s)
        words = list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", "".join(rest)))
        term.update({core(w) for w in words})
        named = [(f"{P.KINDS[k]}:{text[s:e].lower()}", s, e) for s, k, e in spans]
        entity.update({n for n, _, _ in named})
        here = set()
        for name, s, e in named:
            near = [w for w in words if w.end() <= s][-8:] + [w for w in words if w.start() >= e][:8]
            here |= {(name, core(w)) for w in near if len(core(w)) >= 3}
        for x in here:
            pair.setdefault(x, []).append(text)
    return {x: (len(t), term[x[1]], entity[x[0]], len(set(t))) for x, t in pair.items()}


def test_disclosures_like_brute_force(spark):
    """Counts and shares by the definitions; labelled values, whose word touches the entity, among them."""
    r = random.Random(9)
    mails = ["joe@x.com", "amy@y.org", "Amy@Y.org", "10.0.0.7"]
    forms = ["contact:{}", "mailbox:{}", "email={}; name", "<{}>", "tel {} office", "({})"]
    say = lambda: [f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 12))]
    rows = [(i, " ".join(say() + [r.choice(forms).format(r.choice(mails))] + say() + ([r.choice(forms).format(r.choice(mails))] if i % 3 == 0 else []))) for i in range(80)]
    rows += [(100 + i, " ".join(say())) for i in range(40)] + [(200, None), (201, "")] + [(300 + i, rows[0][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x: v for x, v in slow_disclosures(rows).items() if v[3] >= 3}
    got = {(x.entity, x.term): x for x in P.disclosures(docs, P.detect(docs)).collect()}
    assert got.keys() == want.keys() and any(t == "mailbox" for _, t in got)
    for k, (n_pair, n_term, n_entity, support) in want.items():
        x = got[k]
        assert (x.n_pair, x.n_term, x.n_entity, x.support) == (n_pair, n_term, n_entity, support)
        assert n_pair <= min(n_term, n_entity)
        share = math.log2(n_pair * len(rows) / (n_term * n_entity)) / math.log2(len(rows) / n_entity)
        assert abs(x.disclosure - share) < 1e-9 and x.disclosure <= 1 + 1e-9


def test_sanitise_keeps_clashing_columns(spark):
    text = "zorro42 joe@mail.example.com"
    docs = spark.createDataFrame([(1, text, "k", "e", "n"), (2, None, None, None, None)], "doc_id long, text string, _key0 string, _extra0 string, near string")
    got = {x.doc_id: x for x in P.sanitise(docs).collect()}
    assert tuple(got[1])[2:] == ("k", "e", "n") and "[EMAIL]" in got[1].text and tuple(got[2])[1:] == (None,) * 4
    assert P.sanitise(docs.limit(0)).columns == docs.columns


def test_few_and_many_spans_redact_alike(spark, monkeypatch):
    rows = [(i, f"filler{i} talk about zorro42 joe@mail.example.com today number {i}") for i in range(6)] + [(None, None), (9, "")]
    docs = spark.createDataFrame(rows + [(20 + i, f"plain words {i}") for i in range(40)], "doc_id long, text string")
    few = sorted(map(str, P.sanitise(docs).collect()))
    monkeypatch.setattr(P, "FEW_TEXTS", 0)
    assert sorted(map(str, P.sanitise(docs).collect())) == few and not any("zorro42" in x for x in few)
