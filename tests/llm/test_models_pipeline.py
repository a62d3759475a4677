"""Fitted operators on held-out documents, and the pipeline stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontam, packing, pii
from strandline.llm import quality as Q
from strandline.llm import toxicity as T

BAD = ["grumble", "snarl", "sneer", "hiss"]


def word(r):
    return "".join(r.choice(["ba", "ne", "to", "ri", "su", "lo", "ka"]) for _ in range(r.randint(1, 4)))


def make(seed=1, n=400):
    """(documents, labels, benchmark): junk every seventh document, toxic words in every ninth."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [word(r) for _ in range(r.randint(30, 120))]
        if i % 9 == 4:
            for b in r.sample(BAD, r.randint(1, 4)):
                w.insert(r.randint(0, len(w)), b)
        text = " ".join(x.capitalize() + "." if r.random() < 0.1 else x for x in w)
        if i % 7 == 3:
            text = " ".join(x + r.choice(["###", "$$$", "%%%"]) for x in w)
        docs.append((i, text, "en", f"src{i % 5}", len(text)))
        labels.append((i, int(i % 7 != 3), int(i % 9 == 4)))
    return docs, labels, [(k, " ".join("q" + word(r) + str(k) for _ in range(25))) for k in range(3)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, bench = make()
    return (spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), spark.createDataFrame(bench, "item_id long, text string"))


def test_quality_held_out(spark, tables):
    docs, labels, _ = tables
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "src0", 0), (None, "words here", "en", "x", 1)], DOCS)
    odd = docs.union(odd).withColumn("_host", F.lit(1)).withColumn("keep", F.lit("clash"))
    got = {x.doc_id: x for x in Q.classify(odd, labels.where("doc_id < 250")).collect()}
    truth = {x.doc_id: x.quality for x in labels.collect()}
    held = [i for i in truth if i >= 250]
    assert np.mean([got[i].keep == bool(truth[i]) for i in held]) >= 0.97
    assert len(got) == 403
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert all(x.keep for x in Q.classify(docs, labels.limit(0)).collect())
    assert all(x.keep for x in Q.classify(docs, labels.where("quality = 1")).collect())


def test_shrinkage(spark):
    rows = [("a", f"a/{i % 2}", 0.9) for i in range(200)] + [("b", "b/0", 0.1) for _ in range(200)] + [("c", "c/0", 0.0)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _p double")
    sites, mean = Q.site_posteriors(scored)
    prior = {x._path: x._prior for x in sites.collect()}
    # A site of one document stays near the global mean; large ones keep their own.
    assert abs(prior["a/0"] - 0.9) < 0.02 and abs(prior["b/0"] - 0.1) < 0.02
    assert abs(prior["c/0"] - mean) < abs(prior["c/0"] - 0.0)


def test_posteriors_leave_the_document_out(spark, monkeypatch):
    """The closed form at all three levels, document by document; null and empty sources are different sites."""
    r = random.Random(8)
    rows = [(i, word(r), r.choice(["en", None, ""]), r.choice(["a", "b", None, ""]), 1) for i in range(40)]
    rows += [(50, "alone", "en", "single", 1), (51, None, "fr", "single2", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    x = np.random.default_rng(1).normal(size=(60, Q.N_FEATURES))
    model = Q.fit(x, (x[:, 0] > 0).astype(float))
    monkeypatch.setattr(Q, "train", lambda *_: model)
    for bound in (50_000, 0):
        monkeypatch.setattr(Q, "SITE_ROWS", bound)
        got = {d.doc_id: d for d in Q.classify(docs, docs.selectExpr("doc_id", "1 AS quality")).collect()}
        p = {i: got[i].p_document for i, *_ in rows}
        site, host = {i: (s, l) for i, _, l, s, _ in rows}, {i: s for i, _, _, s, _ in rows}
        scored = Q.evidence(docs, model, [F.col("doc_id")])
        k = Q.site_posteriors(scored)[0].select("_k_host", "_k_path").first()
        for i in p:
            rest = [j for j in p if j != i]
            mean = np.mean([p[j] for j in rest])
            own = [p[j] for j in rest if host[j] == host[i]]
            up = (sum(own) + k[0] * mean) / (len(own) + k[0])
            own = [p[j] for j in rest if site[j] == site[i]]
            assert abs(got[i].p_site - (sum(own) + k[1] * up) / (len(own) + k[1])) < 1e-9
    assert abs(Q.classify(docs.where("doc_id = 50"), docs.selectExpr("doc_id", "1 AS quality")).first().p_site - 0.5) < 1e-9


def test_keep_good_keeps_columns(spark, tables, monkeypatch):
    """Both ways to join the sites keep the same rows, whatever other columns are called."""
    docs, labels, _ = tables
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "src0", 0)], DOCS))
    odd = odd.withColumns({"_host": F.lit("h"), "_path": F.lit("p"), "_p": F.lit("q"), "_digest0": F.lit("d"), "c0": F.lit("c")})
    kept = []
    for bound in (50_000, 0):
        monkeypatch.setattr(Q, "SITE_ROWS", bound)
        got = Q.keep_good(odd, labels)
        assert got.columns == odd.columns
        rows = got.collect()
        assert all(tuple(x)[5:] == ("h", "p", "q", "d", "c") for x in rows)
        kept.append(sorted(map(str, rows)))
    assert kept[0] == kept[1] and 300 < len(kept[0]) < 400
    assert Q.keep_good(odd.limit(0), labels).count() == 0


def test_toxicity_held_out(spark, tables):
    docs, labels, _ = tables
    docs = docs.union(spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0)], DOCS)).withColumn("grade", F.lit(1))
    got = {x.doc_id: x for x in T.severity(docs, labels.where("doc_id < 250")).collect()}
    truth = {x.doc_id: x.toxic for x in labels.collect()}
    held = [i for i in truth if i >= 250]
    assert np.mean([got[i].toxic == truth[i] for i in held]) >= 0.97
    texts = {x.doc_id: x.text for x in docs.collect()}
    n = np.array([sum(b in texts[i] for b in BAD) for i in held])
    s = np.array([got[i].expected_severity for i in held])
    assert np.corrcoef(n, s)[0, 1] > 0.85
    assert got[900].toxic == 0 and got[901].toxic == 0
    assert all(x.toxic == 0 for x in T.severity(docs, labels.limit(0)).collect())
    assert T.severity(docs.limit(0), labels).count() == 0


def plain_loss(params, rows, width, grade, weight, l2):
    """The cumulative-link likelihood as it is defined, row by row."""
    w, z = params[:width], params[width:]
    theta = [-np.inf, z[0], *(z[0] + np.cumsum(np.exp(z[1:]))), np.inf]
    at_least = lambda x, t: 1.0 if t == -np.inf else 0.0 if t == np.inf else 1 / (1 + np.exp(t - x))
    out = 0.5 * l2 * sum(w * w) + 0.5e-3 * sum(z[1:] ** 2)
    for own, y, v in zip(rows, grade, weight):
        eta = sum(w[i] for i in own)
        out -= v * np.log(at_least(eta, theta[y]) - at_least(eta, theta[y + 1]))
    return out


def test_cumulative_link_likelihood():
    """Value, gradient and optimum against the definition."""
    r = np.random.default_rng(4)
    width, levels = 4, 3
    rows = [np.flatnonzero(r.random(width) < 0.4) for _ in range(150)]
    eta = np.array([sum(np.array([2.0, 1.0, -1.0, 0.0])[i]) for i in rows]) + r.logistic(size=150)
    grade = np.searchsorted([0.0, 1.0, 2.5], eta)
    weight = r.uniform(0.5, 2, 150)
    x = T.Rows.of(rows, width)
    for _ in range(5):
        p = r.normal(size=width + levels)
        value, gradient = T.loss(p, x, grade, weight, 0.1)
        plain = lambda q: plain_loss(q, rows, width, grade, weight, 0.1)
        assert abs(value - plain(p)) < 1e-8
        numeric = [(plain(p + 1e-6 * e) - plain(p - 1e-6 * e)) / 2e-6 for e in np.eye(len(p))]
        assert np.allclose(gradient, numeric, atol=1e-4)
    w, theta = T.fit(x, grade, levels, weight, 0.1)
    assert (np.diff(theta) > 0).all() and w[0] > w[1] > w[2]
    best = np.concatenate([w, theta[:1], np.log(np.diff(theta))])
    # No step in any of many directions is better.
    for _ in range(200):
        assert plain(best) <= plain(best + r.normal(size=len(best)) * r.choice([1e-3, 1e-2, 0.3])) + 1e-9


def test_grades_are_ordered():
    share = np.array([0.0, 0.1, 0.2, 0.3, 0.3, 0.9, 0.5])
    toxic = np.array([0, 1, 1, 1, 1, 1, 0])
    g = T.grades(share, toxic, 3)
    assert g[0] == g[6] == 0 and (np.diff(g[1:6]) >= 0).all() and g[1] == 1 and g[5] == 3 and g[3] == g[4]
    assert T.grades(share, np.zeros(7), 3).tolist() == [0] * 7


def test_every_informative_word_counts(spark):
    """No bound on the number of words: each of 600 rare toxic words, learned in a few documents, is known."""
    rows, labels = [], []
    for i in range(4000):
        toxic = i % 2
        own = [f"bad{(i // 2) % 600}x", f"bad{(i // 2 + 1) % 600}x"] if toxic else []
        rows.append((i, " ".join([f"w{i % 97}", f"v{i % 89}", *own])))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    old = T.LEAST_Z
    T.LEAST_Z = 1.2
    try:
        model = T.train(docs, labels)
    finally:
        T.LEAST_Z = old
    assert sum(w.startswith("bad") and v > 0 for w, v in model.weights.items()) >= 600


def test_scored_rows_by_definition(spark, monkeypatch):
    """Every column of every row, from a given model, by the formulas of a cumulative link."""
    import math
    import re

    weights, theta = {"foul": 1.5, "mean*": 0.7, "kind": -2.0, "ß": 0.4}, np.array([-1.0, 1.0, 2.0])
    monkeypatch.setattr(T, "train", lambda *a, **k: T.Model(weights, theta))
    r = random.Random(3)
    words = ["foul", "FOUL,", "meanest", "meaning!", "mean", "kind", "ß", "x", "unkind", "foul_kind"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(300)] + [(None, None), (1, "foul"), (1, "foul")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", T.F.lit("clash"))
    got = [tuple(x) for x in T.severity(docs, None).collect()]
    want = []
    for doc_id, text in rows:
        own = set(re.findall(r"[^\W_]+", (text or "").lower()))
        own |= {w[:5] + "*" for w in own if len(w) > 5}
        x = sum(weights.get(w, 0.0) for w in own)
        p = [1.0] + [1 / (1 + math.exp(t - x)) for t in theta] + [0.0]
        each = [a - b for a, b in zip(p, p[1:])]
        want.append((doc_id, sum(p[1:-1]), each.index(max(each)), p[1], int(p[1] >= T.TOXIC_AT)))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert (g[0], g[2], g[4]) == (w[0], w[2], w[4]) and abs(g[1] - w[1]) < 1e-12 and abs(g[3] - w[3]) < 1e-12
    assert {g[2] for g in got} >= {0, 1, 3} and {g[4] for g in got} == {0, 1}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs, labels, bench = make(2, 300)
    docs[10] = (10, docs[11][1], "en", "src0", 1)  # an exact copy of 11
    near = docs[20][1].split()
    docs[300:] = [(300, " ".join(near[:-1] + ["changed"]), "en", "src1", 1), (301, docs[30][1] + " " + bench[0][1], "en", "src1", 1),
                  (302, docs[40][1].replace(".", "") + " write joe.b@mail.example.org now", None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_defined_cases(spark, tmp_path):
    """Nulls in any column, repeated ids, ties, further columns with the names used inside, and empty tables."""
    names = ["_key0", "_extra0", "fp", "component_id", "_host", "_p", "key", "item_id", "c0"]
    docs, labels, bench = make(5, 60)
    docs += [(None, None, None, None, None), (None, docs[0][1], "en", "src0", 1), (900, "", "en", "src0", 0), (1, docs[2][1], None, "", 3), (7, docs[7][1], "en", "src2", 9)]
    rows = spark.createDataFrame(docs, DOCS).withColumns({n: F.lit(n) for n in names})
    rows.write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame(labels, LABELS).union(spark.createDataFrame([(None, None, None), (3, None, 1)], LABELS)).write.parquet(f"{tmp_path}/some/labels.parquet")
    items = spark.createDataFrame([*bench, (None, None), (8, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/some/benchmark.parquet")
    stage_docs = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, f"{tmp_path}/some")
        assert stage_docs.columns == rows.columns
        assert all(tuple(x)[5:] == tuple(names) for x in stage_docs.collect())
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert out.count() > 30
    for name, like in (("documents", rows), ("labels", spark.createDataFrame(labels, LABELS)), ("benchmark", items)):
        like.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.count() == 0 and empty.columns == out.columns


def test_pipeline(spark, sf_dir):
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        kept.append({x.doc_id for x in after.select("doc_id").collect()})
        docs = after
        if len(kept) < 5:
            assert after.columns == before.columns
    every = {x.doc_id for x in before.collect()}
    junk = {i for i in range(300) if i % 7 == 3 and i not in (10,)}
    assert len((every - kept[0]) ^ junk) <= 3
    # Near-duplicates, as sets of five-word shingles of a similarity of 0.8 or more give them.
    texts = {x.doc_id: x.text for x in before.collect()}
    words = {i: texts[i].lower().split() for i in kept[0]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert kept[1] == {i for i in kept[0] if group[i] == i} and 11 not in kept[1] and 300 not in kept[1]
    assert kept[2] == kept[1] - {301}
    assert kept[3] == kept[2] == kept[4]
    clean = pii.stage(spark, before.where("doc_id = 302"), sf_dir).first()
    assert "joe.b" not in clean.text and "[EMAIL]" in clean.text
    final = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(final.doc_id) == kept[4]
    assert final.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert decontam.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 1
