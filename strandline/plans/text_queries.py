"""Queries of text functions, filters and sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..sources import views as V
from .registry import query

RANDOM_SEED = 7
#: Letters of three scripts for those of the alphabet: the test tables hold no Indic text, so documents are written in it.
LATIN = "abcdefghijklmnopqrstuvwxyz"
GURMUKHI = "ਆਬਚਦਏਫਗਹਇਜਕਲਮਨਔਪਖਰਸਤਉਵੳਅਯਝ"
DEVANAGARI = "".join(chr(ord(c) - 0x100) for c in GURMUKHI)
ARABIC = "".join(map(chr, range(0x0628, 0x0628 + 18))) + "فقكلمنهو"
#: By doc_id modulo 5: which letters become which; the others stay. The third mixes two scripts, the last keeps its own.
WRITTEN = ((LATIN, GURMUKHI), (LATIN, DEVANAGARI), (LATIN[:13], GURMUKHI[:13]), (LATIN, ARABIC))

_WRITTEN = " ".join(f"WHEN {i} THEN translate(lower(text), '{a}', '{b}')" for i, (a, b) in enumerate(WRITTEN))
_SCRIPTS = f"scripts AS (SELECT doc_id AS id, CASE doc_id % 5 {_WRITTEN} ELSE text END AS text FROM documents)"


def scripts(spark, sf_dir):
    """(id, text): documents written in several scripts."""
    text, kind = F.col("text"), F.col("doc_id") % 5
    for i, (a, b) in enumerate(WRITTEN):
        text = F.when(kind == i, F.translate(F.lower("text"), a, b)).otherwise(text)
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))


def _sql_translate(column: str, pair: tuple[str, str]) -> str:
    return f"translate({column}, '{pair[0]}', '{pair[1]}')"


_FOLDED = _sql_translate("text", T.INDIC.fold)


@query(V.with_(V.TRANSCRIPT_W) + "SELECT session, window_idx, letters AS first_letters FROM transcript_w")
def first_letters(spark, sf_dir):
    w = V.transcript_w(spark, sf_dir)
    return w.select("session", "window_idx", T.first_letters(F.col("text")).alias("first_letters"))


@query(
    V.with_(_SCRIPTS)
    + f"""SELECT CAST(id AS BIGINT) AS id, array_to_string(list_filter(list_transform(string_split_regex({_FOLDED}, '\\s+'),
    lambda w: {_sql_translate("regexp_extract(w, '[" + T.INDIC.letter + "]')", T.INDIC.canon)}), lambda x: x <> ''), '') AS first_letters
    FROM scripts"""
)
def first_letters_indic(spark, sf_dir):
    return scripts(spark, sf_dir).select("id", T.first_letters(F.col("text"), T.INDIC).alias("first_letters"))


@query(
    V.with_(_SCRIPTS)
    + f"""SELECT CAST(id AS BIGINT) AS id, lower(translate(array_to_string(list_filter(list_transform(string_split_regex({_FOLDED}, '\\s+'),
    lambda w: {_sql_translate("regexp_extract(w, '[" + T.INDIC.letter + "]')", T.INDIC.canon)}), lambda x: x <> ''), ''), '{T.ROMAN[0]}', '{T.ROMAN[1]}')) AS roman
    FROM scripts"""
)
def roman_letters(spark, sf_dir):
    """Keys as searches by romanised first letters have them."""
    return scripts(spark, sf_dir).select("id", T.roman_letters(T.first_letters(F.col("text"), T.INDIC)).alias("roman"))


@query(
    V.with_(V.LINES)
    + """SELECT work_id, line_idx, array_to_string(list_transform(string_split_regex(lower(text), '\\s+'),
    lambda w: regexp_extract(w[1:1], '[a-zà-ÿ]')), '') AS corpus_letters FROM lines"""
)
def first_letters_corpus(spark, sf_dir):
    return V.lines(spark, sf_dir).select(
        "work_id", "line_idx", T.first_letters_corpus(F.col("text")).alias("corpus_letters")
    )


@query(
    V.with_(_SCRIPTS)
    + f"""SELECT CAST(id AS BIGINT) AS id,
    trim(regexp_replace({_FOLDED}, '[^{T.INDIC.word}]+', ' ', 'g')) AS folded FROM scripts"""
)
def script_fold(spark, sf_dir):
    return scripts(spark, sf_dir).select("id", T.script_fold(F.col("text")).alias("folded"))


@query(
    V.with_(_SCRIPTS)
    + """, decided AS (SELECT *, regexp_extract(text, '[਀-੿ऀ-ॿ؀-ۿA-Za-z]') AS c FROM scripts)
    SELECT CAST(id AS BIGINT) AS id, regexp_matches(text, '[਀-੿]') AS gurmukhi, regexp_matches(text, '[ऀ-ॿ]') AS devanagari,
    CASE WHEN c = '' THEN 'unknown' WHEN regexp_matches(c, '[਀-੿]') THEN 'gurmukhi'
         WHEN regexp_matches(c, '[ऀ-ॿ]') THEN 'devanagari' WHEN regexp_matches(c, '[؀-ۿ]') THEN 'arabic'
         ELSE 'latin' END AS label FROM decided"""
)
def script_detect(spark, sf_dir):
    text = F.col("text")
    return scripts(spark, sf_dir).select(
        "id",
        T.has_gurmukhi(text).alias("gurmukhi"),
        T.has_devanagari(text).alias("devanagari"),
        T.script_label(text).alias("label"),
    )


_GARBAGE_SQL = " OR ".join(
    f"regexp_matches(text, '{p.replace('(?d)', '').replace('(?iu)', '(?i)')}')" for p in T.GARBAGE
)
_VALID_SQL = f"""length(text) >= 2 AND NOT ({_GARBAGE_SQL})
  AND NOT list_bool_or(list_transform(range(1, 11), lambda n: length(text) >= 3 * n AND NOT contains(left(text, n), chr(10))
    AND starts_with(text, repeat(left(text, n), 3))))
  AND length(regexp_replace(text, '[^{T.VALID}]', '', 'g')) >= 2"""


@query(V.with_(V.LINES) + f"SELECT work_id, line_idx, {_VALID_SQL} AS valid FROM lines")
def garbage_filter(spark, sf_dir):
    return V.lines(spark, sf_dir).select("work_id", "line_idx", T.is_valid(F.col("text")).alias("valid"))


@query(
    V.with_(V.TRANSCRIPT_W, "w AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM transcript_w)")
    + """SELECT session, window_idx, array_to_string(list_transform(list_filter(range(1, len(ws) + 1),
    lambda i: i = 1 OR ws[i] <> ws[i - 1]), lambda i: ws[i]), ' ') AS text FROM w"""
)
def dedup_words(spark, sf_dir):
    w = V.transcript_w(spark, sf_dir)
    return w.select("session", "window_idx", T.dedup_words(F.col("text")).alias("text"))


#: Folded words of two or more letters, and the phrases made of them, in SQL.
LONG_WORDS = "list_filter(string_split_regex({0}, '[^a-zà-ÿ]+'), lambda x: length(x) >= 2)"
PHRASES = """list_filter([
  CASE WHEN len({0}) >= 2 THEN array_to_string({0}[1:10], ' ') END,
  CASE WHEN len({0}) >= 4 THEN array_to_string({0}[1:4], ' ') END,
  CASE WHEN len({0}) >= 4 THEN array_to_string({0}[len({0}) - 3:len({0})], ' ') END,
  CASE WHEN len({0}) >= 8 THEN array_to_string({0}[len({0}) // 2 - 1:len({0}) // 2 + 2], ' ') END], lambda x: x IS NOT NULL)"""


@query(
    V.with_(
        V.TRANSCRIPT_W,
        f"w AS (SELECT session, window_idx, {LONG_WORDS.format('lower(text)')} AS ws FROM transcript_w)",
        f"p AS (SELECT session, window_idx, {PHRASES.format('ws')} AS ps FROM w)",
    )
    + """SELECT session, window_idx, phrase, CAST(min(i) AS INTEGER) AS first_at FROM (
      SELECT session, window_idx, ps[i] AS phrase, i - 1 AS i FROM p, UNNEST(range(1, len(ps) + 1)) AS u(i))
    GROUP BY ALL"""
)
def phrases(spark, sf_dir):
    """Each distinct phrase with its place before equal phrases were dropped."""
    w = V.transcript_w(spark, sf_dir).select("session", "window_idx", T.long_words(F.col("text")).alias("ws"), "text")
    kept = w.select("session", "window_idx", F.explode(T.phrases(F.col("text"))).alias("phrase"), "ws")
    n = F.size("ws")
    first_ten, first_four = F.array_join(F.slice("ws", 1, 10), " "), F.array_join(F.slice("ws", 1, 4), " ")
    at = (
        F.when(F.col("phrase") == first_ten, 0)
        .when((n >= 4) & (F.col("phrase") == first_four), 1)
        .when((n >= 4) & (F.col("phrase") == F.array_join(F.slice("ws", -4, 4), " ")), 2)
        .otherwise(3)
    )
    return kept.select("session", "window_idx", "phrase", at.alias("first_at"))


_PREV = """prev AS (SELECT *, lag(letters, 1, '') OVER (PARTITION BY session ORDER BY window_idx) AS prev_letters FROM transcript_w)"""


def _with_prev(spark, sf_dir):
    order = W.partitionBy("session").orderBy("window_idx")
    return V.transcript_w(spark, sf_dir).withColumn("prev_letters", F.lag("letters", 1, "").over(order))


@query(
    V.with_(V.TRANSCRIPT_W, _PREV)
    + f"""SELECT session, window_idx, length(letters) >= {C.MIN_LETTERS} AS search_ok,
    greatest(length(letters), length(prev_letters || letters)) >= {C.MIN_LETTERS} AS locked_ok FROM prev"""
)
def min_letters(spark, sf_dir):
    n = F.char_length("letters")
    both = F.char_length(F.concat("prev_letters", "letters"))
    return _with_prev(spark, sf_dir).select(
        "session",
        "window_idx",
        (n >= C.MIN_LETTERS).alias("search_ok"),
        (F.greatest(n, both) >= C.MIN_LETTERS).alias("locked_ok"),
    )


@query(
    V.with_(V.TRANSCRIPT_W, _PREV)
    + """SELECT session, window_idx, array_to_string(CASE WHEN prev_letters = '' OR letters = '' THEN []
    WHEN prev_letters || letters = letters || prev_letters THEN [prev_letters || letters]
    ELSE [prev_letters || letters, letters || prev_letters] END, ',') AS variants FROM prev"""
)
def stitch_variants(spark, sf_dir):
    """Both orders of the previous and the current key, without repeats and without the current key itself."""
    both = F.array_distinct(F.array(F.concat("prev_letters", "letters"), F.concat("letters", "prev_letters")))
    kept = F.filter(both, lambda x: (x != "") & (x != F.col("letters")))
    kept = F.when((F.col("prev_letters") == "") | (F.col("letters") == ""), F.array().cast("array<string>")).otherwise(kept)
    return _with_prev(spark, sf_dir).select("session", "window_idx", F.array_join(kept, ",").alias("variants"))


@query(
    V.with_(V.TRANSCRIPT_W, f"good AS (SELECT session, window_idx, text FROM (SELECT session, window_idx, trim(text) AS text FROM transcript_w) WHERE {_VALID_SQL})")
    + """SELECT session, string_agg(text, ' ' ORDER BY window_idx, text) AS text FROM good GROUP BY session"""
)
def segment_concat(spark, sf_dir):
    """A session's valid texts in time order, as one."""
    w = V.transcript_w(spark, sf_dir)
    segment = F.struct(
        F.col("window_idx").cast("double").alias("start"),
        F.col("window_idx").cast("double").alias("end"),
        F.trim("text").alias("text"),
    )
    joined = w.groupBy("session").agg(F.collect_list(segment).alias("segments"))
    return joined.select("session", T.segment_concat(F.col("segments")).alias("text")).where("text <> ''")


@query(
    V.with_(V.LINES)
    + """SELECT work_id, min_by(text, line_idx) AS text, min_by(letters, line_idx) AS letters,
    coalesce(min_by(source, line_idx), 'G') AS source FROM lines GROUP BY work_id"""
)
def work_lookup(spark, sf_dir):
    """Headers of all works: their first lines."""
    asked = V.lines(spark, sf_dir)
    first = F.min_by(F.struct("text", "letters", "source"), "line_idx").alias("x")
    return asked.groupBy("work_id").agg(first).select(
        "work_id", "x.text", "x.letters", F.coalesce("x.source", F.lit("G")).alias("source")
    )


@query(V.with_(V.LINES) + "SELECT work_id, line_idx, line_id, text, letters FROM lines")
def work_lines(spark, sf_dir):
    lines = V.lines(spark, sf_dir)
    return lines.select("work_id", "line_idx", "line_id", "text", "letters")


@query(
    V.with_(V.LINES)
    + f"""SELECT work_id, line_idx, line_id, text, letters FROM lines
    WHERE work_id = (SELECT work_id FROM lines GROUP BY work_id ORDER BY md5('{RANDOM_SEED}:' || work_id), work_id LIMIT 1)"""
)
def random_work(spark, sf_dir):
    """The lines of a work drawn by a seed: the smallest of the seed's digests, so every work is as likely."""
    lines = V.lines(spark, sf_dir)
    drawn = F.md5(F.concat(F.lit(f"{RANDOM_SEED}:"), F.col("work_id").cast("string")).cast("binary"))
    one = lines.select("work_id").distinct().orderBy(drawn, "work_id").limit(1)
    return lines.join(F.broadcast(one), "work_id").select("work_id", "line_idx", "line_id", "text", "letters")


@query(
    V.with_(V.LINES)
    + """SELECT doc_id AS work_id, coalesce(first_id, 1) AS first_id, coalesce(n, 0) AS n_lines, coalesce(ids, '') AS line_ids
    FROM documents LEFT JOIN (SELECT work_id, min(line_id) AS first_id, count(*) AS n,
      string_agg(CAST(line_id AS VARCHAR), ',' ORDER BY line_idx) AS ids FROM lines WHERE line_id > 0 GROUP BY work_id) x
    ON doc_id = work_id"""
)
def line_ids(spark, sf_dir):
    """Line ids of every work in order; a work without lines gets 1 as its first id."""
    ids = (
        V.lines(spark, sf_dir)
        .where("line_id > 0")
        .groupBy("work_id")
        .agg(F.array_sort(F.collect_list(F.struct("line_idx", "line_id"))).alias("x"))
    )
    ids = ids.select("work_id", F.transform("x", lambda s: s["line_id"]).alias("ids"))
    works = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"))
    return works.join(ids, "work_id", "left").select(
        "work_id",
        F.coalesce(F.get("ids", F.lit(0)), F.lit(1)).cast("long").alias("first_id"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("line_ids"),
    )


RESPONSES = (
    (1, '{"resultsInfo":{"totalResults":2},"verses":[{"shabadId":7,"verseId":70,"pageNo":3,"source":{"sourceId":"B"},"verse":{"unicode":"a b","gurmukhi":"ab"},"translation":{"en":{"bdb":"t"}}},{"shabadId":8,"verse":{"unicode":"c"}}]}'),
    (2, '{"resultsInfo":{"totalResults":0},"verses":[{"shabadId":9}]}'),
    (3, '{"resultsInfo":{"totalResults":1},"verses":[{}]}'),
    (4, "not json"),
)
_RESPONSES = "r(id, j) AS (VALUES " + ", ".join(f"({i}, '{j}')" for i, j in RESPONSES) + ")"


@query(
    "WITH " + _RESPONSES + """, v AS (
      SELECT id, unnest(CAST(json_extract(j, '$.verses') AS JSON[])) AS v FROM r
      WHERE json_valid(j) AND CAST(json_extract(j, '$.resultsInfo.totalResults') AS INTEGER) > 0)
    SELECT CAST(id AS BIGINT) AS id, coalesce(CAST(json_extract(v, '$.shabadId') AS BIGINT), 0) AS work_id,
      coalesce(CAST(json_extract(v, '$.verseId') AS BIGINT), 0) AS line_id,
      coalesce(json_extract_string(v, '$.source.sourceId'), 'G') AS source, coalesce(CAST(json_extract(v, '$.pageNo') AS INTEGER), 0) AS page_no,
      coalesce(json_extract_string(v, '$.verse.unicode'), '') AS text, coalesce(json_extract_string(v, '$.verse.gurmukhi'), '') AS alt_text,
      coalesce(json_extract_string(v, '$.translation.en.bdb'), '') AS translation FROM v
    UNION ALL SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT), event_type, 0, '', '', '' FROM events"""
)
def json_project(spark, sf_dir):
    """Rows of nested responses, with defaults for what is missing, and a field of the events' JSON."""
    from ..sources.connectors import response_rows

    r = response_rows(spark.createDataFrame(list(RESPONSES), "id long, j string"), "j")
    e = V.table(spark, sf_dir, "events")
    k = F.from_json("props", "k bigint")["k"]
    blank = [F.lit("").alias(c) for c in ("text", "alt_text", "translation")]
    e = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("work_id"), k.alias("line_id"),
        F.col("event_type").alias("source"), F.lit(0).alias("page_no"), *blank,
    )
    return r.unionByName(e)


@query(
    """SELECT s_suppkey AS idx, s_name AS name FROM supplier WHERE s_acctbal > 0
    ORDER BY CASE WHEN contains(lower(s_name), '00000007') THEN 0 WHEN contains(lower(s_name), '3') THEN 1 ELSE 2 END, s_suppkey LIMIT 1"""
)
def priority_pick(spark, sf_dir):
    """The preferred device of a list: by name, then by index."""
    from ..sources.connectors import pick_device

    s = V.table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return pick_device(s.select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("name")), ("00000007", "3"))
