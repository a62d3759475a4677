"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger says
which (blob, rule, rule version) pairs have been scanned and what was found. A scan takes the distinct
blobs of the history, drops the pairs that the ledger has, runs the remaining rules over one copy of
each blob, appends to the ledger and joins the findings back to every path that holds the blob.

Spans are code points, end exclusive. They come from the pieces between and the matches of a rule's
pattern: a match starts after all the pieces and matches before it, which a running sum over the rows of a blob's
matches adds up, in time linear in their number.

`Ledger` keeps the entries of all scans in a folder, Parquet by rule and version, so another process goes on where one
ended. A scan that fails adds nothing.

Defined cases: null text is the empty blob; an empty text has no findings; copies are scanned once and
reported for every path; null paths are kept; repeated rows are reported each; texts are scanned whole;
an empty table gives an empty result and an empty ledger; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, shared_dir, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A Java pattern; group `group` of a match must have at least `least` characters, or the match is dropped."""

    name: str
    version: int
    pattern: str
    least: int
    group: int = 0


RULES = (
    Rule(
        "assign", 1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, "[0-9a-f]{32,}", 32),
)
SPANS = "array<struct<start:int,rank:int,name:string,end:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"
PIECES = "array<struct<gap:int,size:int,tested:int>>"


def history(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text) of a table of versions."""
    value = text_or_empty(text)
    return docs.select(F.col(path).cast("long").alias("path"), F.sha2(value.cast("binary"), 256).alias("blob"), value.alias("text"))


def pieces(rule: Rule) -> F.Column:
    """(gap, size, tested) of all matches of a rule in column `text`, in order: lengths, no text."""
    pattern = F.lit(rule.pattern)
    # The arrays are short: a text without a match has none, and nothing of it is copied.
    hits = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.split("text", rule.pattern, -1)
    lengths = F.transform(F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")), lambda x: F.struct(
        F.char_length(x["gap"]).alias("gap"),
        F.char_length(x["hit"]).alias("size"),
        F.char_length(F.regexp_extract(x["hit"], rule.pattern, rule.group)).alias("tested"),
    ))
    return F.when(F.col("text").rlike(rule.pattern), lengths).otherwise(F.lit(None)).cast(PIECES)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new entries: for each rule, the blobs of `versions` that it has not scanned in its version.

    One row per blob and rule. `versions` has the columns of `history`. The copy of a blob that is
    scanned is that of its smallest path, so only hashes and paths are shuffled by blob; texts move once,
    by blob and path, which spreads the copies of a frequent blob.
    """
    prepare(versions.sparkSession)
    pairs = versions.groupBy("blob").agg(F.min("path").alias("path")).select(
        "blob",
        "path",
        F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])).alias("x"),
    ).select("blob", "path", "x.rule", "x.version")
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    unseen = pairs.groupBy("blob", "path").agg(F.collect_set("rule").alias("due"))
    copy = versions.alias("v").join(
        unseen.hint("shuffle_hash").alias("u"),
        (F.col("v.blob") == F.col("u.blob")) & F.col("v.path").eqNullSafe(F.col("u.path")),
    ).select("v.blob", "v.text", "u.due")
    entries = [
        F.when(
            F.array_contains("due", rule.name),
            F.struct(
                F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), F.lit(i).alias("rank"),
                F.lit(rule.least).alias("least"), pieces(rule).alias("pieces"),
            ),
        )
        for i, rule in enumerate(rules)
    ]
    scanned = copy.select("blob", F.array_compact(F.array(*entries)).alias("entries"))
    # A path may repeat with the same text; one entry per blob and rule stays.
    one = scanned.groupBy("blob").agg(F.first("entries").alias("entries")).select("blob", F.explode("entries").alias("x"))
    each = one.select("blob", "x.rule", "x.version", "x.rank", "x.least", F.posexplode_outer("x.pieces").alias("at", "m"))
    # The rows of a blob are together already, so neither the sum nor the grouping shuffles.
    before = W.partitionBy("blob", "rule", "version").orderBy("at")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before).cast("int")
    placed = each.withColumn("end", end)
    span = F.struct((F.col("end") - F.col("m.size")).alias("start"), "rank", F.col("rule").alias("name"), "end")
    good = F.when(F.col("m.tested") >= F.col("least"), span)
    return placed.groupBy("blob", "rule", "version").agg(F.sort_array(F.collect_list(good)).cast(SPANS).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) of every version: the ledger's findings for the current rules, by start, then rule."""
    current = [f"(rule = '{r.name}' AND version = {r.version})" for r in rules]
    by_blob = (
        ledger.where(" OR ".join(current))
        .where(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    empty = F.expr(f"cast(array() AS {SPANS})")
    return versions.select("path", "blob").join(by_blob, "blob", "left").select(
        "path", "blob", F.coalesce("spans", empty).alias("spans")
    )


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings by path, whole ledger) after a scan of a table of versions. The new entries are checkpointed."""
    versions = history(docs)
    whole = scan(versions, ledger, rules).checkpoint()
    if ledger is not None:
        whole = ledger.unionByName(whole)
    return findings(versions, whole, rules), whole


class Ledger:
    """The entries of all scans, in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def entries(self) -> DataFrame | None:
        """LEDGER of all scans so far; None before the first."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(LEDGER).parquet(self.folder)
        except AnalysisException:  # nothing written yet
            return None

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen, add it, and give `findings` of the documents."""
        versions = history(docs)
        new = scan(versions, self.entries(), rules)
        new.sortWithinPartitions("rule", "version", "blob").write.mode("append").partitionBy("rule", "version").parquet(self.folder)
        return findings(versions, self.spark.read.schema(LEDGER).parquet(self.folder), rules)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}").update(table(spark, sf_dir, "documents"))
    counts = [
        F.expr(f"size(filter(spans, x -> x.name = '{r.name}'))").cast("long").alias(f"n_{r.name}") for r in RULES
    ]
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans")
    )


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def oracle_sql() -> str:
    """The same rows for DuckDB: spans from the pieces between matches, too."""
    words = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
    patterns = {
        "assign": f"({words})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
    }
    parts = [
        f"""SELECT rid, '{r.name}' AS name, {i} AS rank, s, s + length(m[i]) AS e,
          length(regexp_extract(m[i], '{patterns[r.name]}', {r.group})) >= {r.least} AS good
        FROM (SELECT rid, m, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
          FROM (SELECT rid, regexp_extract_all(t, '{patterns[r.name]}') AS m,
            string_split_regex(t, '{patterns[r.name]}') AS g FROM d) x, UNNEST(range(1, len(m) + 1)) AS u(i))"""
        for i, r in enumerate(RULES)
    ]
    counts = ", ".join(f"count(*) FILTER (WHERE name = '{r.name}') AS n_{r.name}" for r in RULES)
    names = ", ".join(f"n_{r.name}" for r in RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
      f AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE good),
      s AS (SELECT d.rid, d.doc_id, {counts}, coalesce(string_agg(name || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT),
        ',' ORDER BY s, rank), '') AS spans FROM d LEFT JOIN f ON f.rid = d.rid GROUP BY ALL)
      SELECT doc_id, {names}, sha256(spans) AS base_sha256, spans FROM s"""
