"""Controllers of displays: discovery, display and navigation, as a sink of event streams.

The transport is given, so that the logic runs without a network: `get(url)` and `post(url, payload)` return a status
code and raise OSError where nobody answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from urllib import error, request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Get, Post = Callable[[str], int], Callable[[str, dict], int]


def http_get(url: str, timeout: float = 1.0) -> int:
    try:
        return request.urlopen(url, timeout=timeout).status
    except error.HTTPError as e:
        return e.code


def http_post(url: str, payload: dict, timeout: float = 1.0) -> int:
    asked = request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    try:
        return request.urlopen(asked, timeout=timeout).status
    except error.HTTPError as e:
        return e.code


def discover(ports: Iterable[int], get: Get, host: str = "localhost") -> str | None:
    """The address of the first port, in their order, that answers with 200."""
    for port in ports:
        url = f"http://{host}:{port}"
        try:
            if get(url) == 200:
                return url
        except OSError:
            continue
    return None


class Controller:
    """Shows works and moves along their lines on a display behind HTTP.

    A command that fails is sent once more after a new discovery. `line_ids` gives a work's line ids in order; a
    work without any is shown by the id 1.
    """

    def __init__(self, ports: Sequence[int], line_ids: Callable[[int], list[int]], path: str, pin: int | None = None, get: Get = http_get, post: Post = http_post):
        self.ports, self.line_ids, self.path, self.pin = ports, line_ids, path, pin
        self.get, self.post = get, post
        self.address: str | None = None
        self.work: int | None = None
        self.at = 0

    def connect(self) -> bool:
        self.address = discover(self.ports, self.get)
        return self.address is not None

    def disconnect(self) -> None:
        self.address, self.work, self.at = None, None, 0

    def search(self, query: str) -> bool:
        """The display's payloads have no search."""
        return False

    def select(self, index: int = 0) -> bool:
        """The display's payloads have no choice of a result."""
        return False

    def _send(self, payload: dict) -> bool:
        if self.pin is not None:
            payload = payload | {"pin": str(self.pin)}
        for attempt in range(2):
            if (self.address and attempt == 0) or self.connect():
                try:
                    if self.post(self.address + self.path, payload) == 200:
                        return True
                except OSError:
                    pass
        return False

    def _show(self, work: int, at: int) -> bool:
        ids = self.line_ids(work) or [1]
        at = min(max(at, 0), len(ids) - 1)
        # Names fixed by the display.
        shown = {
            "type": "shabad", "shabadId": work, "id": work, "verseId": ids[at], "lineCount": at + 1, "highlight": ids[at],
            "homeId": ids[0],
        }
        if not self._send(shown):
            return False
        self.work, self.at = work, at
        return True

    def display(self, work: int) -> bool:
        return self._show(work, 0)

    def navigate(self, direction: str = "next") -> bool:
        if self.work is None or not self.line_ids(self.work):
            return False  # without lines there is nowhere to go
        return self._show(self.work, self.at - 1 if direction == "prev" else self.at + 1)


def control_sink(controller: Controller) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends the display and navigate events of one session's stream, in order."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        told = batch.where(F.col("type").isin("display", "navigate")).orderBy("window_idx", "seq")
        for row in told.toLocalIterator():
            if row.type == "display":
                controller.display(row.work_id)
            else:
                controller.navigate(json.loads(row.detail).get("direction", "next"))

    return deliver


def read_lines(lines: DataFrame, work_id: int) -> DataFrame:
    """What a client gets that asks for a work: one row (work_id, lines) with the lines in order."""
    mine = lines.where(F.col("work_id") == work_id)
    each = F.sort_array(F.collect_list(F.struct("line_idx", "text"))).alias("lines")
    return mine.agg(each).select(F.lit(work_id).alias("work_id"), F.transform("lines", lambda x: x["text"]).alias("lines"))


def snapshot(events: DataFrame) -> DataFrame:
    """What a new client gets: each session's latest state event."""
    order = F.struct("window_idx", "seq")
    latest = F.max_by(F.struct("window_idx", "work_id", "line", "detail"), order).alias("x")
    return events.where("type = 'state'").groupBy("session").agg(latest).select("session", "x.*")


def stop_all(spark) -> int:
    """Stop all streaming queries of the session; how many there were."""
    active = spark.streams.active
    for q in active:
        q.stop()
    return len(active)
