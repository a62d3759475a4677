"""The stored index: the rows of the plans that make postings, added to by work, read by few row groups."""

import random

from pyspark.sql import functions as F

from strandline.operators import retrieve as R
from strandline.sources.index import LINE, StoredIndex

SF = "/root/testdata/sf0.001"


def lines_of(spark):
    from strandline.sources import views as V

    return V.lines(spark, SF)


def asked(spark):
    """Queries with keys and texts of lines, parts of them, and nothing known."""
    rows = lines_of(spark).orderBy("work_id", "line_idx").limit(400).collect()
    r = random.Random(2)
    out = []
    for i, x in enumerate(r.sample(rows, 60)):
        a = r.randrange(max(1, len(x.letters) - 4))
        out.append((i, x.letters[a : a + r.choice((3, 4, 6, 30))], " ".join(x.text.split()[: r.choice((2, 4, 12))])))
    long = next(x for x in rows if 8 <= len(x.letters) <= 30)
    out += [(100, "zzzqqq", "nothing like this anywhere"), (101, "", ""), (102, "ab", "one"), (103, long.letters, long.text), (104, long.letters, long.text)]
    return spark.createDataFrame(out, "qid long, letters string, text string")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_rows_as_without_it(spark, tmp_path):
    lines, q = lines_of(spark).cache(), asked(spark)
    index = StoredIndex(spark, f"{tmp_path}/index")
    index.add(lines.where("work_id % 3 = 0"))
    index.add(lines.where("work_id % 3 = 1"))
    # Another process adds works, some of which are there; what it adds is found by this one.
    other = StoredIndex(spark, f"{tmp_path}/index")
    assert other.runs == index.runs and len(other.runs) == 2
    other.add(lines.where("work_id % 3 <> 1"))
    assert len(index.runs) == 2
    index.refresh()
    assert index.runs == other.runs and len(index.runs) == 3 and same(index.lines(), lines.select(*index.lines().columns))
    for compacted in (False, True):
        for search in (R.prefix, R.contains, R.subkey, R.phrase, R.cascade):
            assert same(search(q, index), search(q, lines)), search
            if search in (R.phrase, R.cascade):
                assert same(search(q, index, start_mode=True), search(q, lines, start_mode=True)), search
        if not compacted:
            index.compact()
            assert len(index.runs) == 1
    assert R.contains(q, index).count() > 100


def test_automaton_and_postings(spark, monkeypatch):
    """Over lines alone: a few queries by one automaton, more by postings made in the plan, with the same rows."""
    lines, q = lines_of(spark).cache(), asked(spark)
    searches = [lambda: R.contains(q, lines), lambda: R.phrase(q, lines), lambda: R.phrase(q, lines, start_mode=True), lambda: R.cascade(q, lines)]
    one = [s().collect() for s in searches]
    plans = [searches[i]()._jdf.queryExecution().optimizedPlan().toString() for i in (0, 1)]
    assert all("MapInArrow" in p and "Generate explode(" not in p for p in plans)
    monkeypatch.setattr(R, "SCANNED", 3)
    assert "MapInArrow" not in searches[0]()._jdf.queryExecution().optimizedPlan().toString()
    assert [sorted(map(str, a)) for a in one] == [sorted(map(str, s().collect())) for s in searches]
    assert R.scan(lines.limit(3), F.col("letters"), []).count() == 0


def test_many_keys_are_joined(spark, tmp_path, monkeypatch):
    from strandline.sources import index as I

    lines, q = lines_of(spark).cache(), asked(spark)
    index = StoredIndex(spark, f"{tmp_path}/index")
    index.add(lines)
    for few, held, most in ((1000, 300, 3), (3, 300, 3), (3, 3, 1_000_000), (3, 3, 3)):
        monkeypatch.setattr(I, "FEW", few)
        monkeypatch.setattr(I, "HELD", held)
        monkeypatch.setattr(I, "BROADCAST_KEYS", most)
        assert same(R.contains(q, index), R.contains(q, lines)) and same(R.phrase(q, index), R.phrase(q, lines))


def test_no_line_is_taken_apart_in_a_search(spark, tmp_path):
    index = StoredIndex(spark, f"{tmp_path}/index")
    index.add(lines_of(spark))
    q = asked(spark)
    for search in (R.prefix, R.contains, R.phrase):
        plan = search(q, index)._jdf.queryExecution().optimizedPlan().toString()
        # What is exploded are keys of queries: no plan has a Generate above a scan of lines.
        for part in plan.split("Generate")[1:]:
            found = [part.find(x) for x in ("LogicalRDD", "Relation [")]
            assert found[0] >= 0 and (found[1] < 0 or found[0] < found[1]), part
        # One query: its postings are looked up already, its lines are read by work.
        physical = search(q.where("qid = 103"), index)._jdf.queryExecution().executedPlan().toString()
        scans = physical.split("FileScan")[1:]
        assert scans and all("letters#" in x.split("]")[0] and "work_id" in x.split("PushedFilters")[1] for x in scans), physical


def test_few_keys_read_few_rows(spark, tmp_path):
    """A search reads the postings of its keys' partitions alone."""
    index = StoredIndex(spark, f"{tmp_path}/index", buckets=32)
    index.add(lines_of(spark))
    all_ = index.postings("grams").count()
    q = asked(spark).where("qid = 103").select("qid", F.slice(R.grams(F.col("letters"), 3), 1, 1).alias("keys"))
    part = index._of(index.postings("grams"), q.select(F.explode("keys").alias("k")))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan and ("EqualTo(k" in plan or "In(k" in plan), plan
    files = {x[0] for x in part.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("b=")[1].split("/")[0] for f in files}) == 1 and 0 < part.count() < all_ / 20


def test_writers_that_add_at_once(spark, tmp_path):
    """A writer that lost the race adds again, without the works of the one that won."""
    lines = lines_of(spark).where("work_id < 40").cache()
    one, two = (StoredIndex(spark, f"{tmp_path}/index") for _ in range(2))
    write = two._write

    def slow(new):
        two._write = write
        made = write(new)
        one.add(lines.where("work_id < 30"))
        return made

    two._write = slow
    two.add(lines.where("work_id >= 20"))
    assert two.generation == 2 and two.runs[:1] == one.runs
    assert same(two.lines(), lines.select(*two.lines().columns))


def test_empty(spark, tmp_path):
    index = StoredIndex(spark, f"{tmp_path}/index")
    q = asked(spark)
    assert R.cascade(q, index).count() == 0
    index.add(spark.createDataFrame([], LINE))
    assert R.cascade(q, index).count() == 0 and index.lines_of(index.works()).count() == 0
    index.add(spark.createDataFrame([(1, 0, 1, None, "ab cd ef", "ace"), (2, 0, 2, "s", "", "")], LINE))
    assert R.contains(spark.createDataFrame([(1, "ace", "x")], "qid long, letters string, text string"), index).count() == 1
