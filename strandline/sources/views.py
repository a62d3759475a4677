"""Views of the test tables: corpus lines, windows of several kinds. Each has its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

LINE_BREAK = r"[.!?\n]+\s*"
#: Keys of the lines that the replay speaks: long enough to be searched, short enough for one window.
SPOKEN_LETTERS = (6, 199)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows in at least as many tasks as there are cores.

    A table of one small file is one task, however much is made of each row; only such tables are dealt out.
    A scan that already has a task per core, as every large table's, is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _keyed(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(text, LINE_BREAK), lambda t: F.struct(t.alias("text"), T.first_letters(t).alias("letters"))),
        lambda x: x["letters"] != "",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, source, line_idx, line_id, text, letters): keyed lines; the index is dense, so no shuffle is needed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(_keyed(F.col("text"))))
    return docs.select(
        F.col("doc_id").alias("work_id"),
        "source",
        F.col("pos").alias("line_idx"),
        (F.col("doc_id") * 100000 + F.col("pos") + 1).alias("line_id"),
        "col.text",
        "col.letters",
    )


_LETTERS = "array_to_string(list_transform(string_split_regex(lower({0}), '\\s+'), lambda w: regexp_extract(w, '[a-zà-ÿ]')), '')"
LINES = f"""
keyed AS (
  SELECT doc_id, source, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+\\s*'),
    lambda t: {{'text': t, 'letters': {_LETTERS.format('t')}}}), lambda x: x.letters <> '') AS arr
  FROM documents
), lines AS (
  SELECT doc_id AS work_id, source, CAST(i - 1 AS INTEGER) AS line_idx, doc_id * 100000 + i AS line_id,
         arr[i].text AS text, arr[i].letters AS letters
  FROM keyed, UNNEST(range(1, len(arr) + 1)) AS u(i)
)"""


def queries_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text, letters): benchmark items as windows of their own."""
    return table(spark, sf_dir, "benchmark").select("item_id", "text", T.first_letters(F.col("text")).alias("letters"))


QUERIES_W = f"queries_w AS (SELECT item_id, text, {_LETTERS.format('text')} AS letters FROM benchmark)"


def transcript_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, window_idx, silent, text, letters): conversations as transcripts, some windows silent."""
    c = table(spark, sf_dir, "conversations")
    silent = (F.col("conv_id") + F.col("turn")) % 5 == 4
    text = F.when(silent, "").otherwise(F.col("text"))
    return c.select(
        F.col("conv_id").alias("session"),
        F.col("turn").alias("window_idx"),
        silent.alias("silent"),
        text.alias("text"),
        T.first_letters(text).alias("letters"),
    )


TRANSCRIPT_W = f"""
spoken AS (
  SELECT conv_id AS session, turn AS window_idx, (conv_id + turn) % 5 = 4 AS silent,
         CASE WHEN (conv_id + turn) % 5 = 4 THEN '' ELSE text END AS text FROM conversations
), transcript_w AS (SELECT *, {_LETTERS.format('text')} AS letters FROM spoken)"""


def level_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, window_idx, ts, event_type, level, has_vocals): events as level windows in arrival order."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("session"),
        F.row_number().over(order).alias("window_idx"),
        "ts",
        "event_type",
        F.col("value").alias("level"),
        (F.col("value") > 20).alias("has_vocals"),
    )


LEVEL_W = """
level_w AS (
  SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS window_idx,
         ts, event_type, value AS level, value > 20 AS has_vocals FROM events
)"""

#: Works are grouped in blocks of ids for the replay, so that no window spans the whole table.
REPLAY_BLOCK = 64


def replay_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, window_idx, silent, work_id, line_idx, text, letters): four lines of a work, a silent window, four
    lines of the next work that qualifies in its block of ids (the first follows the last)."""
    fit = lines(spark, sf_dir).where(F.char_length("letters").between(*SPOKEN_LETTERS))
    place = W.partitionBy("work_id").orderBy("line_idx")
    head = (
        fit.withColumn("n", F.row_number().over(place))
        .where("n <= 6")
        .groupBy("work_id")
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("line_idx", "text", "letters"))).alias("head"))
        .where("n = 6")
        .select("work_id", F.slice("head", 1, 4).alias("head"))
    )
    block = W.partitionBy(F.floor(F.col("work_id") / REPLAY_BLOCK)).orderBy("work_id")
    whole = block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pairs = head.select(
        "work_id",
        "head",
        F.coalesce(F.lead("work_id").over(block), F.first("work_id").over(whole)).alias("next_id"),
        F.coalesce(F.lead("head").over(block), F.first("head").over(whole)).alias("next_head"),
    )
    silent = F.struct(F.lit(None).cast("int").alias("line_idx"), F.lit("").alias("text"), F.lit("").alias("letters"))
    out = pairs.select(
        F.col("work_id").alias("session"), "next_id", F.posexplode(F.concat("head", F.array(silent), "next_head"))
    )
    work = F.when(F.col("pos") < 4, F.col("session")).when(F.col("pos") > 4, F.col("next_id"))
    return out.select(
        "session",
        F.col("pos").alias("window_idx"),
        (F.col("pos") == 4).alias("silent"),
        work.alias("work_id"),
        "col.line_idx",
        "col.text",
        "col.letters",
    )


REPLAY_W = f"""
fit AS (
  SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY line_idx) AS n FROM lines
  WHERE length(letters) BETWEEN {SPOKEN_LETTERS[0]} AND {SPOKEN_LETTERS[1]}
), good AS (
  SELECT work_id, lead(work_id) OVER (PARTITION BY work_id // {REPLAY_BLOCK} ORDER BY work_id) AS after,
         min(work_id) OVER (PARTITION BY work_id // {REPLAY_BLOCK}) AS first_id
  FROM fit WHERE n = 6
), replay_w AS (
  SELECT g.work_id AS session, CAST(f.n - 1 AS INTEGER) AS window_idx, false AS silent, f.work_id, f.line_idx, f.text, f.letters
  FROM good g JOIN fit f ON f.work_id = g.work_id AND f.n <= 4
  UNION ALL SELECT work_id, 4, true, NULL, NULL, '', '' FROM good
  UNION ALL
  SELECT g.work_id, CAST(f.n + 4 AS INTEGER), false, f.work_id, f.line_idx, f.text, f.letters
  FROM good g JOIN fit f ON f.work_id = coalesce(g.after, g.first_id) AND f.n <= 4
)"""


def with_(*views: str) -> str:
    """A WITH clause of views, to be followed by a query."""
    return "WITH RECURSIVE " + ", ".join(views) + " "
