"""Retrieval: windows joined with corpus lines by prefix, containment, sub-key and phrase, and the cascade.

`queries` has (qid, letters, text); `corpus` is a DataFrame of lines (work_id, line_idx, source, text, letters), whose
postings are then made in the plan, or a stored index (`sources.index.StoredIndex`) that has them. Every strategy
gives (qid, work_id, line_idx, source, text, letters, pos): pos counts the hits kept for a query, in the
order (work_id, line_idx).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .. import config as C
from ..functions import text as T
from . import meet as M
from .heads import head, meeting
from .keep import keep

_LINE = ("work_id", "line_idx", "source", "text", "letters")


def _top(hits: DataFrame, limit: int, key: str = "qid") -> DataFrame:
    order = W.partitionBy(key).orderBy("work_id", "line_idx")
    return hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def _line(corpus: DataFrame, *more: Column) -> DataFrame:
    return corpus.select(*_LINE, *more)


#: Distinct keys of queries up to this number, at most some 30 MB, go to the corpus first, so that only postings with such
#: a key leave their task.
BROADCAST_KEYS = 1_000_000


def _asked(postings: DataFrame, q: DataFrame) -> DataFrame:
    """The postings whose key `k` some query has, where the queries' keys are few enough to be broadcast; else all."""
    keys = q.select("k").distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return postings.join(F.broadcast(keys), "k", "left_semi") if few else postings


def _stored(corpus) -> bool:
    return not isinstance(corpus, DataFrame)


#: Patterns up to this number and size go through the lines as one automaton; more meet them by postings.
SCANNED, SCANNED_CHARS = 2_000, 200_000


def _patterns(q: DataFrame, column: str) -> list[str] | None:
    """The distinct values of a column, if they are few and short enough for one automaton."""
    found = [r[0] for r in q.select(column).distinct().limit(SCANNED + 1).collect()]
    return found if len(found) <= SCANNED and sum(map(len, found)) <= SCANNED_CHARS else None


def scan(lines: DataFrame, text: Column, patterns: list[str]) -> DataFrame:
    """(the lines' columns, `pattern`) of every pattern that occurs in a line's text: one pass over the lines by an Aho-Corasick
    automaton of all patterns, which each task makes once."""
    names = lines.columns
    schema = StructType([*lines.schema.fields, StructField("pattern", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text_ in enumerate(batch.column(len(names)).to_pylist()):
                own = {p for _, p in automaton.iter(text_)} if text_ else ()
                rows += [i] * len(own)
                found += own
            kept = batch.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], schema=arrow)

    if not patterns:
        return lines.where("false").withColumn("pattern", F.lit(None).cast("string"))
    return lines.select(*names, text.alias("_scanned")).mapInArrow(run, schema)


def _many(q: DataFrame, lines: DataFrame, limit: int, anywhere: bool, parts: tuple[int, ...]) -> DataFrame:
    """The first hits of many queries (qid, query). Equal ones are asked once; `parts` are the last works of all parts of the lines but
    the last, and a query that has its hits is not asked of the next part."""
    asked = keep(q.select("query").distinct().withColumn("k", head("query")))
    inside = F.contains("letters", "query") if anywhere else F.startswith("letters", "query")
    found, open_, after = None, asked, None
    for last in (*parts, None):
        own = lines if after is None else lines.where(F.col("work_id") > after)
        own, after = own if last is None else own.where(F.col("work_id") <= last), last
        met = meeting(own, open_, anywhere).join(open_, "k").where(inside).select("query", *_LINE)
        hits = _top(met, limit, "query").drop("pos")
        hits = keep(hits)
        found = hits if found is None else found.union(hits)
        if last is not None:
            full = found.groupBy("query").count().where(F.col("count") >= limit)
            open_ = asked.join(full, "query", "left_anti")
    return _top(found, limit, "query").join(q, "query").select("qid", *_LINE, "pos")


def prefix(queries: DataFrame, corpus, limit: int = C.PREFIX_LIMIT, parts: tuple[int, ...] = ()) -> DataFrame:
    """The query's letters begin the line's: an equi-join on the shortest key, then the rest. Where `parts` of
    the lines are named, many queries meet these by their heads."""
    q = queries.where(F.char_length("letters") >= C.MIN_LETTERS).select(
        "qid", F.col("letters").alias("query"), F.left("letters", F.lit(C.MIN_LETTERS)).alias("k")
    )
    if _stored(corpus):
        found = corpus.hits("heads", q.select("qid", "query", F.array("k").alias("keys")))
    elif parts and _patterns(q, "query") is None:
        return _many(q.drop("k"), _line(corpus), limit, False, parts)
    else:
        found = _line(corpus, F.left("letters", F.lit(C.MIN_LETTERS)).alias("k")).join(q, "k")
    return _top(found.where(F.startswith("letters", "query")).select("qid", *_LINE), limit)


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    last = F.char_length(text) - n + 1
    return F.when(
        last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))


def contains(queries: DataFrame, corpus, limit: int = C.CONTAINS_LIMIT, parts: tuple[int, ...] = ()) -> DataFrame:
    """The query's letters occur in the line's. A stored index looks up the query's rarest three letters. Over lines alone a few
    queries go through them as one automaton; more meet them by their heads where `parts` are named, and are else an equi-join of their first three
    letters with the lines' postings."""
    q = queries.where(F.char_length("letters") >= C.MIN_LETTERS).select("qid", F.col("letters").alias("query"))
    if _stored(corpus):
        found = corpus.hits("grams", q.withColumn("keys", grams(F.col("query"), C.MIN_LETTERS)))
    elif (patterns := _patterns(q, "query")) is not None:
        found = scan(_line(corpus), F.col("letters"), patterns).join(q, F.col("pattern") == F.col("query"))
    elif parts:
        return _many(q, _line(corpus), limit, True, parts)
    else:
        q = q.withColumn("k", F.left("query", F.lit(C.MIN_LETTERS)))
        found = _asked(_line(corpus, F.explode(grams(F.col("letters"), C.MIN_LETTERS)).alias("k")), q).join(q, "k")
    return _top(found.where(F.contains("letters", "query")).select("qid", *_LINE), limit)


def subkey(queries: DataFrame, corpus, limit: int = C.SUBKEY_LIMIT) -> DataFrame:
    """Prefix joins of a query's first and last four letters; adds `part`."""
    parts = queries.where(F.char_length("letters") > C.SUBKEY).select(
        "qid",
        F.posexplode(F.array(F.left("letters", F.lit(C.SUBKEY)), F.right("letters", F.lit(C.SUBKEY)))).alias("part", "letters"),
    )
    key = F.struct("qid", "part").alias("qid")
    hits = prefix(parts.select(key, "letters"), corpus, limit)
    return hits.select(F.col("qid.part").alias("part"), F.col("qid.qid").alias("qid"), *_LINE, "pos")


def bigrams(text: Column, script: T.Script = T.LATIN) -> Column:
    """Distinct pairs of neighbouring folded words."""
    return word_pairs(T.script_fold(text, script))


def word_pairs(folded: Column) -> Column:
    """`bigrams` of a text that is folded already."""
    # The words are named outside the lambda: inside, they would be made anew for every pair.
    w = F.split(folded, " ")
    rest = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(w, 1, F.size(rest)), rest, lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(pairs)


def phrase(
    queries: DataFrame, corpus, limit: int = C.PHRASE_LIMIT, start_mode: bool = False, script: T.Script = T.LATIN
) -> DataFrame:
    """Each phrase of the transcript occurs in the line as whole words; adds `part`, the phrase's number."""
    q = queries.select("qid", F.posexplode(T.phrases(F.col("text"), start_mode, script)).alias("part", "phrase"))
    q = q.select(F.struct("qid", "part").alias("qid"), "phrase")
    if _stored(corpus):
        found = corpus.hits("pairs", q.withColumn("keys", word_pairs(F.col("phrase"))))
        found = found.withColumn("_folded", T.script_fold(F.col("text"), script))
    elif (patterns := _patterns(q, "phrase")) is not None:
        padded = F.concat(F.lit(" "), T.script_fold(F.col("text"), script), F.lit(" "))
        found = scan(_line(corpus), padded, [f" {p} " for p in patterns])
        found = found.join(q, F.col("pattern") == F.concat(F.lit(" "), "phrase", F.lit(" "))).withColumn("_folded", F.col("phrase"))
    else:
        q = q.withColumn("k", F.substring_index("phrase", " ", 2))
        folded = T.script_fold(F.col("text"), script).alias("_folded")
        c = _line(corpus, folded).select(*_LINE, "_folded", F.explode(word_pairs(F.col("_folded"))).alias("k"))
        found = _asked(c, q).join(q, "k")
    inside = F.contains(F.concat(F.lit(" "), "_folded", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" ")))
    hits = found.where(inside).select("qid", *_LINE)
    return _top(hits, limit).select(F.col("qid.part").alias("part"), F.col("qid.qid").alias("qid"), *_LINE, "pos")


def merge(hits: DataFrame, *keys: str, line: tuple[str, ...] = _LINE[1:]) -> DataFrame:
    """Union of strategies by work: the first line retrieved stays, tags are collected, `place` orders the works.

    `hits` has (qid, work_id, ..., ord, pos, tag); ord and pos give the order of retrieval. Other `keys` than qid may be named, and other
    columns of a `line`.
    """
    keys = keys or ("qid",)
    first = F.struct("ord", "pos", *line)
    works = hits.groupBy(*keys, "work_id").agg(
        F.min_by(first, F.struct("ord", "pos")).alias("first"), F.sort_array(F.collect_set("tag")).alias("tags")
    )
    order = W.partitionBy(*keys).orderBy("first.ord", "first.pos")
    return works.select(
        *keys,
        "work_id",
        *[f"first.{c}" for c in line],
        "tags",
        F.row_number().over(order).alias("place"),
    )


def _tagged(hits: DataFrame, ord_: Column, tag: str) -> DataFrame:
    return hits.select("qid", *_LINE, ord_.alias("ord"), "pos", F.lit(tag).alias("tag"))


def cascade(queries: DataFrame, corpus, start_mode: bool = False, script: T.Script = T.LATIN) -> DataFrame:
    """All strategies with their conditions, merged.

    Containment runs for queries with fewer than three works so far (none, in start mode), sub-keys for fewer
    than two and more than four letters; phrases always. Lines alone meet all of it in one pass (`cascades`). Of an index the
    conditions are anti-joins on counted works, so
    the dear joins see only the queries that need them. The hits that conditions count are kept, at most
    ten rows a query and strategy: they are read several times.
    """
    if not _stored(corpus):
        return cascades(queries.withColumn("start", F.lit(start_mode)), corpus, (start_mode,), script).drop("start")
    q = queries
    if start_mode:
        q = q.withColumn("letters", F.left("letters", F.lit(C.START_LETTERS)))
    first = keep(_tagged(prefix(q, corpus), F.lit(0), "type0"))
    n0 = first.groupBy("qid").agg(F.countDistinct("work_id").alias("n"))
    few = q.join(n0.where(F.col("n") >= (1 if start_mode else 3)).select("qid"), "qid", "left_anti")
    second = keep(_tagged(contains(few, corpus), F.lit(1), "type1"))
    n01 = first.union(second).groupBy("qid").agg(F.countDistinct("work_id").alias("n"))
    fewer = q.join(n01.where("n >= 2").select("qid"), "qid", "left_anti")
    third = subkey(fewer, corpus)
    third = _tagged(third, F.col("part") + 2, "type0_sub")
    last = phrase(q.where(T.strip(F.col("text")) != ""), corpus, C.PHRASE_LIMIT, start_mode, script)
    last = _tagged(last, F.col("part") + 4, "type2")
    return merge(first.unionByName(second).unionByName(third).unionByName(last))


def _asked_at(start_mode: bool, script: T.Script) -> Column:
    """All that the strategies may ask for a query's `letters` and `text`, null where one asks nothing; the index is the strategy's place in the cascade."""
    letters = F.left("letters", F.lit(C.START_LETTERS)) if start_mode else F.col("letters")
    whole = F.when(F.char_length(letters) >= C.MIN_LETTERS, letters)
    part = F.when(F.char_length(letters) > C.SUBKEY, letters)
    keys = F.array(whole, whole, F.left(part, F.lit(C.SUBKEY)), F.right(part, F.lit(C.SUBKEY)))
    return F.concat(keys, F.coalesce(T.phrases(F.col("text"), start_mode, script), F.array().cast("array<string>")))


def _kind(ord_: Column) -> Column:
    return F.when(ord_ == 1, M.INSIDE).when(ord_ < 4, M.PREFIX).otherwise(M.PHRASE)


def _asks(queries: DataFrame, start_mode: bool, script: T.Script) -> DataFrame:
    """(qid, start, ord, kind, ask): all that the strategies may ask for each query; `ord` is the strategy's place in the cascade."""
    each = queries.select("qid", F.lit(start_mode).alias("start"), F.posexplode(_asked_at(start_mode, script)).alias("ord", "ask"))
    return each.where("ask IS NOT NULL").withColumn("kind", _kind(F.col("ord")))


def _of_place(values: tuple, ord_: Column) -> Column:
    """The value of a strategy's place in the cascade."""
    return F.element_at(F.array(*map(F.lit, values)), F.least(ord_, F.lit(len(values) - 1)) + 1)


def cascades(queries: DataFrame, lines: DataFrame, modes: tuple[bool, ...] = (False, True), script: T.Script = T.LATIN) -> DataFrame:
    """The cascade of one or both search modes over lines alone: merged works by (qid, start). `queries` has (qid, letters, text, start); those
    without `start` are not searched in start mode.

    Everything that may be asked goes through the lines in one pass (`operators.meet`); each ask keeps its first hits once, however many queries
    have it, and the conditions then choose among the strategies' hits. Rows of a query lie together from then on.
    """
    asks = [_asks(queries.where("start") if mode else queries, mode, script) for mode in modes]
    asked = asks[0] if len(asks) == 1 else asks[0].union(asks[1])
    asked = keep(asked.withColumn("k", M.key("ask", "kind")))
    folded = T.script_fold(F.col("text"), script)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    distinct = keep(asked.select("k", "kind", "ask").distinct())
    inside = (
        F.when(F.col("kind") == M.PREFIX, F.startswith("letters", "ask"))
        .when(F.col("kind") == M.INSIDE, F.contains("letters", "ask"))
        .otherwise(F.contains(pad(folded), pad(F.col("ask"))))
    )
    hits = M.meeting(_line(lines), folded, distinct).join(distinct, "k").where(inside)
    order = W.partitionBy("k", "ask").orderBy("work_id", "line_idx")
    hits = hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= max(_LIMITS))
    # The hash is the key, and that of equal texts differs by kind; that the texts are equal is left to a condition, so that nothing is dealt anew.
    hits = hits.withColumnRenamed("ask", "_ask").drop("kind")
    same = F.startswith("_ask", "ask") & F.startswith("ask", "_ask")
    own = hits.join(asked, "k").where(same & (F.col("pos") <= _of_place(_LIMITS, F.col("ord"))))
    own = _chosen(own.select("qid", "start", "ord", "pos", *_LINE).repartition("qid"))
    return merge(own, "qid", "start")


def _chosen(own: DataFrame) -> DataFrame:
    """Of the strategies' hits (qid, start, ord, work_id, ...) those whose conditions hold, with their `tag`."""
    by = W.partitionBy("qid", "start")
    works = lambda last: F.size(F.collect_set(F.when(F.col("ord") <= last, F.col("work_id"))).over(by))
    few = F.col("_n0") < F.when(F.col("start"), 1).otherwise(3)
    fewer = F.when(few, F.col("_n1")).otherwise(F.col("_n0")) < 2
    own = own.withColumns({"_n0": works(0), "_n1": works(1)})
    own = own.where((F.col("ord") == 0) | (F.col("ord") >= 4) | F.when(F.col("ord") == 1, few).otherwise(fewer))
    return own.withColumn("tag", _of_place(_TAGS, F.col("ord"))).drop("_n0", "_n1")


#: Where a line is, for what does without its text; `line` tells lines of equal places apart, as works may come more than once.
PLACE = ("line_idx", "line")


def placed(lines: DataFrame) -> DataFrame:
    return _line(lines, F.hash("source", "text", "letters").alias("line"))


#: By the strategy's place in the cascade; the last is that of all phrases.
_LIMITS = (C.PREFIX_LIMIT, C.CONTAINS_LIMIT, C.SUBKEY_LIMIT, C.SUBKEY_LIMIT, C.PHRASE_LIMIT)
_TAGS = ("type0", "type1", "type0_sub", "type0_sub", "type2")
#: How many places the cascade has; uses of an ask in start mode are counted from there.
_PLACES = len(_LIMITS) - 1 + T.PHRASES


def asked(queries: DataFrame, both: bool, script: T.Script = T.LATIN) -> DataFrame:
    """(qid, kind, ask, uses): what the strategies may ask for each query, once, with the places in the cascade that ask for it. With `both` queries that
    have `start` are searched in start mode too."""
    ask = lambda mode: F.transform(
        _asked_at(mode, script), lambda x, i: F.struct(_kind(i).alias("kind"), x.alias("ask"), (i + int(mode) * _PLACES).cast("byte").alias("use"))
    )
    uses = F.filter(ask(False), lambda x: x["ask"].isNotNull())
    if both:
        uses = F.concat(uses, F.filter(ask(True), lambda x: x["ask"].isNotNull() & F.col("start")))
    each = queries.select("qid", uses.alias("uses"))
    distinct = F.array_distinct(F.transform("uses", lambda x: F.struct(x["kind"].alias("kind"), x["ask"].alias("ask"))))
    each = each.select("qid", "uses", F.inline(distinct))
    mine = F.filter("uses", lambda x: (x["kind"] == F.col("kind")) & (x["ask"] == F.col("ask")))
    return each.select("qid", "kind", "ask", F.transform(mine, lambda x: x["use"]).alias("uses"))


def cascade_places(asked: DataFrame, lines: DataFrame, script: T.Script = T.LATIN) -> DataFrame:
    """`cascades` of what many queries ask (`asked`, which is read several times), with the lines' `PLACE` in the lines' stead: merged works by (qid, start).

    Tasks send what is asked of their lines, not the lines: the stretch, whole, and where it is, and of a stretch no more than the most hits that a
    strategy keeps. A hit comes to a query once, with all modes and strategies that ask for it.
    """
    met = M.places(placed(lines), ["work_id", *PLACE], T.script_fold(F.col("text"), script), asked.withColumn("k", M.key("ask", "kind")))
    order = W.partitionBy("kind", "ask").orderBy("work_id", *PLACE)
    hits = met.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= max(_LIMITS))
    ord_ = lambda use: F.pmod(use.cast("int"), F.lit(_PLACES))
    most = F.array_max(F.transform("uses", lambda x: _of_place(_LIMITS, ord_(x))))
    own = hits.join(asked, ["kind", "ask"]).where(F.col("pos") <= most)
    own = own.select("qid", "uses", F.col("pos").cast("byte").alias("pos"), "work_id", *PLACE).repartition("qid")
    own = own.select("qid", F.explode("uses").alias("use"), "pos", "work_id", *PLACE)
    own = own.select("qid", (F.col("use") >= _PLACES).alias("start"), ord_(F.col("use")).alias("ord"), "pos", "work_id", *PLACE)
    return merge(_chosen(own.where(F.col("pos") <= _of_place(_LIMITS, F.col("ord")))), "qid", "start", line=PLACE)
