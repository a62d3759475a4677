"""Sources and sinks of the live path: searches of the corpus service, clients that follow, commands among windows, event time."""

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from strandline.operators import retrieve as R
from strandline.operators import windows as O
from strandline.sources import connectors as K
from strandline.sources import fanout, search
from strandline.streaming import run

SF = "/root/testdata/sf0.001"


# -- searches -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    """Lines that the stand-in serves; its workers read where they are from a file of options."""
    from strandline.sources import views as V

    path = str(tmp_path_factory.mktemp("served") / "lines.json")
    rows = V.lines(spark, SF).orderBy("work_id", "line_idx").collect()
    with open(path, "w") as f:
        f.writelines(json.dumps(x.asDict()) + "\n" for x in rows)
    # The function of the transport is found by its module, which knows the file.
    module = tmp_path_factory.mktemp("module") / "served_here.py"
    here = os.path.dirname(os.path.abspath(__file__))
    module.write_text(f"import os, sys\nsys.path.insert(0, {here!r})\nos.environ['SERVED_LINES'] = {path!r}\nfrom served_corpus import get\n")
    spark.sparkContext.addPyFile(str(module))
    return rows


def test_searches_by_pushed_filters(spark, served):
    search.register(spark)
    read = lambda: spark.read.format("corpus_search").option("transport", "served_here:get").option("results", 8).load()
    long = [x for x in served if len(x.letters) >= 6][:4]
    keys, inside = [x.letters[:4] for x in long], [x.letters[2:5] for x in long]
    phrases = [" ".join(x.text.lower().split()[1:3]).strip(",;:'\"") for x in long]
    lines = spark.createDataFrame(served)
    for kind, asked, join in (
        (0, keys, lambda q: R.prefix(q, lines, 8)), (1, inside, lambda q: R.contains(q, lines, 8)), (2, phrases, None),
    ):
        df = read().where((F.col("kind") == kind) & F.col("query").isin(*asked, "broken", "odd", "zzzz"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.rdd.getNumPartitions() == len(set(asked)) + 3 and "corpus_search" in plan
        got = sorted((x.query, x.place, x.work_id, x.line_id, x.source, x.text, x.alt_text, x.translation) for x in df.collect())
        assert got and all(g[6:] == ("g", "") for g in got)
        if join:
            q = spark.createDataFrame([(a, a, "") for a in set(asked)], "qid string, letters string, text string")
            ids = {(x.work_id, x.line_idx): x.line_id for x in served}
            want = sorted((x.qid, x.pos, x.work_id, ids[x.work_id, x.line_idx], x.source, x.text) for x in join(q).collect())
            assert [g[:6] for g in got] == want
    # Many searches at once, each made once; and what Spark itself still filters.
    q = spark.createDataFrame([(0, k) for k in keys * 2] + [(1, ""), (0, "broken")], "kind int, query string")
    many = search.searched(q, {"transport": "served_here:get", "results": "8"}, tasks=3)
    one = read().where((F.col("kind") == 0) & F.col("query").isin(*keys))
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert one.where("place = 1").count() == len({x.query for x in one.collect()})
    assert read().where("query = ''").count() == 0
    with pytest.raises(Exception, match="filter on query"):
        read().count()


def test_http_transport_gives_up():
    assert search.search(search.http("http://127.0.0.1:9", 0.2), 0, "abc") == []


# -- clients ------------------------------------------------------------------------------------


class Client:
    def __init__(self, fail_at=()):
        self.got, self.fail_at, self.connected = [], set(fail_at), 0

    def connect(self):
        self.connected += 1
        if "connect" in self.fail_at:
            raise OSError("away")
        return self.send

    def send(self, message):
        if len(self.got) in self.fail_at:
            self.fail_at.discard(len(self.got))
            raise OSError("gone")
        self.got.append(message)


def test_fan_out(spark, tmp_path):
    """Epochs that fail or run again are delivered once; a client that fails comes back where it was, and holds up no other."""
    spark.dataSource.register(fanout.FanOut)
    schema, stop = "session long, window_idx long, text string", tmp_path / "stop"

    @F.udf("string")
    def fragile(text):
        if os.path.exists(str(stop)):
            raise RuntimeError("killed")
        return text

    def go():
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/p*").withColumn("text", fragile("text"))
        q = rows.writeStream.format("fan_out").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
        q.trigger(availableNow=True).start().awaitTermination()

    def add(i):
        spark.createDataFrame([(i, k, f"é{i}.{k}") for k in range(5)], schema).coalesce(2).write.parquet(f"{tmp_path}/in/p{i}")

    now = [0.0]
    steady, shaky, away = Client(), Client({3, 7}), Client({"connect"})
    subs = [fanout.Subscription(f"{tmp_path}/out", n, c.connect, clock=lambda: now[0]) for n, c in (("a", steady), ("b", shaky), ("c", away))]
    add(0)
    go()
    assert [s.poll() for s in subs] == [5, 3, 0]
    assert [s.poll() for s in subs] == [0, 0, 0] and shaky.connected == 1, "left alone for three seconds"
    add(1)
    stop.write_text("")
    with pytest.raises(StreamingQueryException):
        go()
    stop.unlink()
    go()
    # Spark runs the last epoch again after a crash between the sink's commit and its own.
    os.remove(f"{tmp_path}/c/commits/1")
    crc = f"{tmp_path}/c/commits/.1.crc"
    if os.path.exists(crc):
        os.remove(crc)
    go()
    assert len(os.listdir(f"{tmp_path}/out/messages")) == len({f for e in fanout.Log(f"{tmp_path}/out").names("log") for f in fanout.Log(f"{tmp_path}/out").lines(f"log/{e}")})
    now[0] = 3.1
    away.fail_at.clear()
    assert [s.poll() for s in subs] == [5, 4, 10]  # the second client fails once more
    now[0] = 6.3
    assert [s.poll() for s in subs] == [0, 3, 0] and shaky.connected == 3
    want = [json.dumps({"session": i, "window_idx": k, "text": f"é{i}.{k}"}, ensure_ascii=False) for i in (0, 1) for k in range(5)]
    for c in (steady, shaky, away):
        assert sorted(c.got) == want and sorted(c.got[:5]) == want[:5]
    # Another process goes on for a client that is known, and a new one gets all.
    again, fresh = Client(), Client()
    assert fanout.Subscription(f"{tmp_path}/out", "b", again.connect).poll() == 0
    assert fanout.Subscription(f"{tmp_path}/out", "d", fresh.connect).poll() == 10


# -- commands -----------------------------------------------------------------------------------


def test_commands_and_windows_meet_by_arrival(spark, tmp_path):
    """JSON messages and windows as two streams, out of order within the delay, give the events of the batch."""
    from strandline.plans.match_queries import index
    from strandline.plans.track_queries import replay_commands
    from strandline.sources import views as V

    lines = index(spark, SF)
    windows = V.replay_w(spark, SF).where("session < 8").select("session", "window_idx", "silent", "text")
    second = lambda c: F.timestamp_seconds(1_700_000_000 + c)
    windows = windows.withColumn("arrived", second(F.col("window_idx") * 3)).cache()
    told = replay_commands(spark, SF).where("session < 8")
    name = {"manual_select": "shabad_id", "recall": "shabad_id", "navigate": "direction", "set_confidence_mode": "mode"}
    rows = []
    for x in told.collect():
        body = {"type": x.command} | ({name[x.command]: x.arg} if x.command in name else {})
        at = 3.0 * x.window_idx - 1
        rows.append((x.session, at, json.dumps(body)))
        if x.command == "pause":  # several commands between two windows keep their order
            rows += [(x.session, at + 0.2, '{"type": "resume"}'), (x.session, at + 0.4, '{"type": "pause"}'), (x.session, at + 0.5, "{no json"), (x.session, at + 0.6, '{"type": "dance"}')]
    messages = spark.createDataFrame(rows, "session long, at double, message string").select("session", second(F.col("at")).alias("arrived"), "message").cache()
    placed = run.place_commands(windows, messages)
    assert {(x.session, x.window_idx, x.command) for x in told.collect()} <= {(x.session, x.window_idx, x.command) for x in placed.collect()}
    assert placed.where("ord > 0").count() == 2 * windows.select("session").distinct().count() > 10
    batch = run.track(run.rows(run.clean(windows), lines, placed))
    want = sorted(map(tuple, batch.collect()), key=str)
    end = spark.createDataFrame([(999, 0, True, "")], "session long, window_idx int, silent boolean, text string").withColumn("arrived", second(F.lit(10_000)))
    r = random.Random(4)
    for i, (a, b) in enumerate(((0, 9), (9, 18), (18, 90))):
        for df, where in ((windows, "w"), (messages, "m")):
            t = F.unix_timestamp("arrived") - 1_700_000_000
            # Some come up to six seconds late: with the next part.
            late = F.pmod(F.xxhash64("session", "arrived"), F.lit(3)) == 0
            shifted = F.when(late & (t >= 0), t + 6).otherwise(t)
            df.where((shifted >= a - (1 if i == 0 else 0)) & (shifted < b)).orderBy(F.rand(r.randint(0, 99))).coalesce(1).write.parquet(f"{tmp_path}/{where}/p{i}")
    end.coalesce(1).write.parquet(f"{tmp_path}/w/p9")
    schemas = [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for df in (windows, messages)]
    w, m = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{p}/p*") for s, p in zip(schemas, "wm"))
    both = run.place_command_stream(w, m, "10 seconds")
    run.prepare_batches(both, lines, f"{tmp_path}/rows", f"{tmp_path}/c1").start().awaitTermination()
    log = run.event_log(run.track_stream(run.row_stream(spark, f"{tmp_path}/rows")), f"{tmp_path}/events", f"{tmp_path}/c2")
    log.trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(x) for x in spark.read.parquet(f"{tmp_path}/events").collect() if x.session != 999), key=str)
    assert got == want and len(got) > 100


# -- event time ---------------------------------------------------------------------------------


def test_windows_of_event_time_as_a_stream(spark, tmp_path):
    """Events shuffled within the watermark give the batch's windows; later ones are left out."""
    from strandline.sources import views as V

    e = V.table(spark, SF, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("level"))
    e = e.where("session < 40").cache()
    first, last = e.selectExpr("unix_timestamp(min(t))", "unix_timestamp(max(t))").first()
    rows = e.collect()
    r = random.Random(6)
    # Arrival: up to two hours after the event.
    rows.sort(key=lambda x: x.t.timestamp() + r.random() * 7200)
    too_late = [(x.session, x.t, 1e6) for x in rows[:5]]
    n = len(rows)
    tick = [(-1, max(x.t for x in rows).replace(year=2100), 0.0)]
    for i, part in enumerate((rows[: n // 3], rows[n // 3 : 2 * n // 3], rows[2 * n // 3 :], too_late + tick)):
        spark.createDataFrame([tuple(x) for x in part], e.schema).coalesce(1).write.parquet(f"{tmp_path}/e/p{i}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e/p*")
    made = O.slide_by_time(stream, "10 hours", "3 hours", "2 hours", watermark="3 hours")
    q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").where("session >= 0").collect()]
    want = [tuple(x) for x in O.slide_by_time(e, "10 hours", "3 hours", "2 hours").collect()]
    assert sorted(got) == sorted(want) and len(want) > 100 and len(set(g[:2] for g in got)) == len(got)
