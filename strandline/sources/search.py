"""The corpus service's search as a batch source: filters on the search become requests, one partition each.

    spark.dataSource.register(CorpusSearch)
    hits = spark.read.format("corpus_search").option("transport", "package.module:function").load()
    hits.where("kind = 0 AND query IN ('abc', 'bcd')")

Every combination of a kind and a query that the filters name is a request; it needs at least one query. Kinds are those of the service:
0 letters that begin a line's key, 1 letters inside it, 2 words of its text. A request that fails, finds nothing, or answers with
something else gives no rows. `place` counts the lines of an answer from 1; at most `results` (10) are kept.

`transport` names a function of (path, parameters) that gives the answer's JSON text, importable on the executors. Without it,
requests go by HTTP to `url`, and give up after `timeout` (8) seconds. Filters are pushed down where the session has
spark.sql.python.filterPushdown.enabled, which `register` sets.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

KINDS = (0, 1, 2)
RESULTS, TIMEOUT = 10, 8.0
SCHEMA = (
    "kind int, query string, place int, work_id long, line_id long, source string, page_no int, text string, alt_text string, "
    "translation string"
)

Transport = Callable[[str, dict], str]


def http(url: str, timeout: float = TIMEOUT) -> Transport:
    def get(path: str, parameters: dict) -> str:
        where = f"{url.rstrip('/')}{path}?{urllib.parse.urlencode(parameters)}"
        with urllib.request.urlopen(where, timeout=timeout) as answer:
            return answer.read().decode()

    return get


def transport_of(options: dict) -> Transport:
    if "transport" in options:
        module, _, name = options["transport"].partition(":")
        return getattr(importlib.import_module(module), name)
    return http(options["url"], float(options.get("timeout", TIMEOUT)))


def rows_of(answer: str, limit: int) -> Iterator[tuple]:
    """(place, work_id, ..., translation) of an answer; names fixed by the service."""
    data = json.loads(answer)
    if not data.get("resultsInfo", {}).get("totalResults", 0):
        return
    for place, entry in enumerate(data.get("verses", [])[:limit], 1):
        verse, english = entry.get("verse") or {}, (entry.get("translation") or {}).get("en") or {}
        yield (
            place, int(entry.get("shabadId") or 0), int(entry.get("verseId") or 0), (entry.get("source") or {}).get("sourceId") or "G",
            int(entry.get("pageNo") or 0), verse.get("unicode") or "", verse.get("gurmukhi") or "", english.get("bdb") or "",
        )


def search(transport: Transport, kind: int, query: str, limit: int = RESULTS) -> list[tuple]:
    """Rows (SCHEMA) of one request."""
    try:
        path = f"/search/{urllib.parse.quote(query, safe='')}"
        return [(kind, query, *row) for row in rows_of(transport(path, {"searchtype": kind, "results": limit}), limit)]
    except Exception:  # a service that is away, or answers with something else
        return []


class Request(InputPartition):
    def __init__(self, kind: int, query: str):
        self.kind, self.query = kind, query


class CorpusSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kinds, self.queries = options, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters on kind and query; the others stay with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("kind",), ("query",)):
                yield f
            elif f.attribute == ("kind",):
                self.kinds = values if self.kinds is None else self.kinds & values
            else:
                self.queries = values if self.queries is None else self.queries & values

    def partitions(self) -> list[Request]:
        if self.queries is None:
            raise ValueError("a search needs a filter on query: =, or IN")
        kinds = KINDS if self.kinds is None else sorted(set(KINDS) & self.kinds)
        # Spark wants a partition even where nothing is asked for.
        return [Request(k, q) for k, q in product(kinds, sorted(q for q in self.queries if q))] or [Request(-1, "")]

    def read(self, partition: Request) -> Iterator[tuple]:
        if not partition.query:
            return iter(())
        return iter(search(transport_of(self.options), partition.kind, partition.query, int(self.options.get("results", RESULTS))))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSearch)


def searched(queries: DataFrame, options: dict, tasks: int | None = None) -> DataFrame:
    """Rows (SCHEMA) of many requests (kind, query), each made once, in `tasks` tasks: so many at a time reach the service."""
    limit = int(options.get("results", RESULTS))

    def run(batches):
        import pandas as pd

        send = transport_of(options)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for kind, query in zip(batch["kind"], batch["query"]):
                if found := search(send, int(kind), query, limit):
                    yield pd.DataFrame(found, columns=names)

    asked = queries.select("kind", "query").where("query <> ''").distinct()
    asked = asked.repartition(tasks, "kind", "query") if tasks else asked.repartition("kind", "query")
    return asked.mapInPandas(run, SCHEMA)
