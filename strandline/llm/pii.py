"""Personal data: pattern spans, and terms that give protected entities away.

Base spans (e-mail, ip, card, phone) come from whole texts by fixed patterns. Beyond them this is
information-theoretic sanitisation: over the whole corpus it estimates for every protected entity e and
every term t that stands near it

    PMI(t; e) = log2( p(t, e) / (p(t) p(e)) ),      IC(e) = -log2 p(e)

p(t, e): share of documents with t within `window` words of e; p(t), p(e): shares of documents with t, with
e. disclosure = PMI / IC is the part of the entity's information that the term reveals; it is 1 at most, as
each document that counts for a pair counts for its term and its entity. A term whose
pair was seen in at least `support` different texts (copies are no support) and that discloses `generalise_at` or more is generalised
where it stands near the entity; at `remove_at` or more it is removed.

Words are those of the text with its base spans blanked out, so `email:x@y.z` holds the word `email:`, next to
the address. A term is a word without the punctuation around it, of three characters or more. One function
makes the words for both sides, those near an entity and those counted.

Defined cases: null text is empty; an empty text has no spans; texts are scanned whole, in time
linear in their length; repeated texts get equal spans; an entity in
every text has IC 0 and no term discloses it; an empty table gives an empty result; other columns are
ignored, and kept by `sanitise`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import arrow_rows, free_name, prepare, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, SUPPORT, GENERALISE_AT, REMOVE_AT = 8, 3, 0.5, 0.8
#: Candidate terms up to this number go to the tasks as a set; more are joined by a shuffle.
TERM_SET = 100_000
#: Texts with added spans up to this number, and ten times as many spans, go to the tasks: at most some 30 MB.
FEW_TEXTS = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behinds only skip starts inside a digit run whose own start has failed already.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; found from each @, so that a long run of letters costs no more than its length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        else:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, entity) by start, then kind."""
    spans = [(s, 0, e, text[s:e].translate(_LOWER)) for s, e in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append((m.start(), 1, m.end(), ".".join(parts)))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                spans.append((m.start(), 3, m.end(), digits))
    return sorted(spans)


def term_of(word: str) -> str:
    return word.strip(_EDGE).translate(_LOWER)


def blanked(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with spaces in place of its base spans; all other characters keep their places."""
    out, at = [], 0
    for start, _, end, _ in spans:
        if end > at:
            start = max(start, at)
            out += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*out, text[at:]]) if out else text


def contexts(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms within WINDOW words of each base span."""
    if not spans:
        return []
    plain = blanked(text, spans)
    words = [m.span() for m in _WORD.finditer(plain)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out = []
    for start, kind, end, entity in spans:
        name = f"{KINDS[kind]}:{entity}"
        i, j = bisect_right(ends, start), bisect_left(starts, end)
        for a, b in words[max(0, i - WINDOW) : i] + words[j : j + WINDOW]:
            word = plain[a:b]
            core = word.strip(_EDGE)
            if len(core) >= 3:
                s = a + word.find(core)
                out.append((name, term_of(word), s, s + len(core)))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.string()), ("base", pa.list_(_SPAN)), ("near", pa.list_(_NEAR)),
     ("held", pa.list_(pa.string()))]
)
FOUND = "doc_id long, key string, base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:string,term:string,start:int,end:int>>, held array<string>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, near, held) of every row; key is the SHA-256 of the text, held its distinct entities."""

    def one(doc_id, text):
        spans = base_spans(text)
        key = hashlib.sha256(text.encode()).hexdigest()
        near = [dict(zip(("entity", "term", "start", "end"), x)) for x in contexts(text, spans)]
        held = list(dict.fromkeys(f"{KINDS[k]}:{entity}" for _, k, _, entity in spans))
        yield doc_id, key, [{"start": s, "kind": k, "end": e} for s, k, e, _ in spans], near, held

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(arrow_rows(_FOUND, one), FOUND)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): the number of documents that hold each of the terms, added up in each task first."""
    some = [r[0] for r in terms.limit(TERM_SET + 1).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(some) if len(some) <= TERM_SET else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        only = shared.value

        def out():
            return pa.RecordBatch.from_pydict(
                {"term": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())}
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                here = {term_of(w) for w in set(_WORD.findall(blanked(text, base_spans(text))))}
                count.update(here & only if only is not None else here)
            if len(count) > 2 * TERM_SET:
                yield out()
                count.clear()
        yield out()

    held = docs.select(text_or_empty()).mapInArrow(run, "term string, n long")
    if len(some) > TERM_SET:
        held = held.join(terms, "term", "left_semi")
    return held.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, support, n_pair, n_term, n_entity, disclosure) of all pairs with enough support."""
    total = found.count()
    pair = F.expr("array_distinct(transform(near, x -> struct(x.entity AS entity, x.term AS term)))")
    pairs = found.where(F.size("near") > 0).select("key", F.explode(pair).alias("x")).select("key", "x.*")
    by_text = pairs.groupBy("key", "entity", "term").agg(F.count("*").alias("n"))
    n_pair = by_text.groupBy("entity", "term").agg(F.count("*").alias("support"), F.sum("n").alias("n_pair"))
    n_pair = n_pair.where(F.col("support") >= support).checkpoint()
    n_entity = found.select(F.explode("held").alias("entity"))
    n_entity = n_entity.groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_term = term_counts(docs, n_pair.select("term").distinct())
    pmi = F.log2(F.col("n_pair") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    ic = F.log2(F.lit(float(total)) / F.col("n_entity"))
    return (
        n_pair.join(n_entity, "entity")
        .join(n_term, "term")
        .withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    )


def plan(docs: DataFrame, support: int = SUPPORT, generalise_at: float = GENERALISE_AT) -> tuple[DataFrame, DataFrame]:
    """`detect`'s rows, and (key, extra) with the added spans of each text that has any."""
    prepare(docs.sparkSession)
    found = detect(docs).checkpoint()
    told = disclosures(docs, found, support).where(F.col("disclosure") >= generalise_at)
    places = (
        found.where(F.size("near") > 0)
        .select("key", F.explode("near").alias("x"))
        .select("key", "x.entity", "x.term", "x.start", "x.end")
        .distinct()
        .join(told.select("entity", "term", "disclosure"), ["entity", "term"])
        .groupBy("key", "start", "end")
        .agg(F.max("disclosure").alias("disclosure"))
    )
    extra = places.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("extra"))
    return found, extra.checkpoint()


def spans_text(spans: str) -> F.Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, base spans, all spans."""
    found, extra = plan(docs)
    more = F.expr(
        "transform(coalesce(extra, array()), x -> named_struct('start', x.start, 'kind', 4, 'end', x.end))"
    )
    rows = found.join(extra, "key", "left").withColumn("spans", F.sort_array(F.concat("base", more)))
    counts = [F.expr(f"size(filter(base, x -> x.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return rows.select(
        "doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans")
    )


def redact(text: str, extra: list[tuple[int, int, float]]) -> str:
    """Replace base spans by their kind, terms by a general class, and drop the most disclosing ones."""
    cuts = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e, _ in base_spans(text)]
    for s, e, told in extra:
        word = text[s:e]
        general = "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"
        cuts.append((s, e, "" if told >= REMOVE_AT else general))
    out, at = [], 0
    for s, e, by in sorted(cuts):
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with their texts redacted; n_chars, if there, follows the text.

    The added spans go to all tasks where they are few; where they are many, texts and spans meet in a shuffle.
    """
    _, extra = plan(docs)
    texts, spans = extra.agg(F.count("*"), F.sum(F.size("extra"))).first()
    few = texts <= FEW_TEXTS and (spans or 0) <= 10 * FEW_TEXTS
    names = docs.columns
    key, more = free_name(docs, "_key"), free_name(docs, "_extra")
    keyed = docs.withColumn(key, F.sha2(text_or_empty().cast("binary"), 256))
    extra = extra.withColumnsRenamed({"key": key, "extra": more})
    joined = keyed.join(F.broadcast(extra) if few else extra, key, "left")
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, extras = batch.columns
            texts = [
                t if t is None else redact(t, [(x["start"], x["end"], x["disclosure"]) for x in more or ()])
                for t, more in zip(columns[at].to_pylist(), extras.to_pylist())
            ]
            columns[at] = pa.array(texts, pa.string())
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if count is not None else docs
    schema = StructType([StructField(f.name, f.dataType, True) for f in kept.schema.fields])
    return joined.select(*[F.col(f"`{c}`").cast(t) for c, t in kept.dtypes], more).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)
