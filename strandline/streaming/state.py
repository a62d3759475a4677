"""Typed state of live sessions: what a window said before, and where the tracker is.

A session's state is split by how it changes. The tracker's scalars are one value, its hypotheses a map of at most
`HYPOTHESES` works, the keys of the current work and of the one kept for silence a map that is written only when one of them
changes, and past works a list that is only added to; it is read when a recall asks for one. A row therefore reads and writes a
bounded number of bytes, however long a session lasts. A session without rows for as long as `idle` is forgotten by a timer,
and past works by their time to live, `remembered`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import fold

#: Typed state is kept by this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_typed_state(spark: SparkSession) -> None:
    """Streams that are started from now on keep typed state, which `clean_stream` and `track_stream` need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Sessions(StatefulProcessor):
    """A processor whose sessions are forgotten after `idle` milliseconds without rows; never, if that is None."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "at long") if self.idle else None

    def touch(self, timers) -> None:
        if self.idle:
            now = timers.getCurrentProcessingTimeInMs()
            if not self.active.exists():
                self.handle.registerTimer(now + self.idle)
            self.active.update((now,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, last = timerValues.getCurrentProcessingTimeInMs(), self.active.get()[0]
        if now - last >= self.idle:
            self.forget()
            self.active.clear()
        else:
            self.handle.registerTimer(last + self.idle)
        return iter(())

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Cleaner(Sessions):
    """Windows without what the window before said; commands go through. Windows that come late or again are dropped.

    Rows are (session, window_idx, silent, text, command, arg, ord), the text without garbage.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.said = handle.getValueState("said", "last string, repeats int, window_idx long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.touch(timerValues)
        last, repeats, at = self.said.get() if self.said.exists() else ("", 0, -1)
        for row in sorted(rows, key=lambda r: (r["window_idx"], r["command"] is None, r["ord"])):
            text = row["text"]
            if row["command"] is None:
                if row["window_idx"] <= at:
                    continue
                at = row["window_idx"]
                text, last, repeats = fold.deoverlap(last, repeats, text)
            yield Row(**(row.asDict() | {"text": text}))
        self.said.update((last, repeats, at))

    def forget(self) -> None:
        self.said.clear()


class Aligner(Sessions):
    """Commands put among a session's windows by their time of arrival, as far as the watermark lets it be known.

    Rows are (session, at, window_idx, silent, text, command, arg), `at` in microseconds; a command has no window_idx. It gets that
    of the window that comes next, and `ord` counts the commands before that window. What arrives at one time
    comes commands first. Rows wait in state until the watermark has passed them.
    """

    NAMES = ("at", "window_idx", "silent", "text", "command", "arg")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at long, window_idx long, silent boolean, text string, command string, arg string")
        self.last = handle.getValueState("last", "window_idx long, ord int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.NAMES) for r in rows]
        self.waiting.appendList(new)
        for at in {r[0] // 1000 for r in new}:
            self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((x for x in held if x[0] // 1000 < until), key=lambda x: (x[0], x[4] is None, x[1] or 0, x[4] or "", x[5] or ""))
        if not ready:
            return
        rest = [x for x in held if x[0] // 1000 >= until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        last, n = self.last.get() if self.last.exists() else (-1, 0)
        made = []
        for at, window_idx, silent, text, command, arg in ready:
            if command is None:
                last, n = max(last, window_idx), 0
                made.append((window_idx, silent, text, None, None, 0))
            else:
                made.append((last + 1, None, None, command, arg, n))
                n += 1
        self.last.update((last, n))
        for window_idx, silent, text, command, arg, n in made:
            yield Row(session=key[0], window_idx=window_idx, silent=silent, text=text, command=command, arg=arg, ord=n)

    def forget(self) -> None:
        self.waiting.clear()


SESSION = (
    "phase string, work_id long, line int, pending long, wins int, misses int, rival long, rival_wins int, weak int, silence int, "
    "in_break boolean, boost int, armed_id long, armed_score double, armed_left int, previous string, rate double, paused boolean, "
    "mode string, pin long, last_window long, earlier long"
)
_SAME = ("phase", "pending", "wins", "misses", "rival", "rival_wins", "weak", "silence", "in_break", "boost", "armed_left", "previous",
         "rate", "paused", "mode", "pin", "last_window", "earlier")
_NAMES = [c.split()[0] for c in SESSION.split(", ")]


class Tracker(Sessions):
    """The tracker's step over a session's rows; `events(state, row)` gives the rows to pass on."""

    def __init__(self, events: Callable[[fold.State, dict], Any], names: list[str], idle: int | None = None, remembered: int | None = None):
        super().__init__(idle)
        self.events, self.names, self.remembered = events, names, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.scalars = handle.getValueState("session", SESSION)
        self.hypotheses = handle.getMapState("hypotheses", "work_id long", "place int, line int, score double, total double, seen long, stability int")
        self.keys = handle.getMapState("keys", "work_id long", "keys array<string>")
        ttl = (self.remembered,) if self.remembered else ()
        self.past = handle.getListState("past", "work_id long, line int", *ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.touch(timerValues)
        rows = [r.asDict() for r in rows]
        rows.sort(key=lambda r: (r["window_idx"], r["seq"], r["ord"]))
        recall = any(r["command"] == "recall" for r in rows)
        state, keys = self.load(recall)
        # All of a micro-batch first, as a generator that is not read to its end would lose the state.
        out = [e for row in rows for e in self.events(state, row)]
        self.store(state, keys, recall)
        for e in out:
            yield Row(**dict(zip(self.names, e)))

    def load(self, recall: bool) -> tuple[fold.State, dict[int, list[str]]]:
        if not self.scalars.exists():
            return fold.State(), {}
        v = dict(zip(_NAMES, self.scalars.get()))
        keys = {k[0]: list(x[0]) for k, x in self.keys.iterator()}
        s = fold.State(**{n: v[n] for n in _SAME})
        if v["work_id"] is not None:
            s.current = fold.Work(v["work_id"], v["line"], keys.get(v["work_id"], []))
        if v["armed_id"] is not None:
            s.armed = {"work_id": v["armed_id"], "score": v["armed_score"], "keys": keys.get(v["armed_id"], [])}
        found = sorted((x[0], k[0], x[1:]) for k, x in self.hypotheses.iterator())
        s.hypotheses = {k: fold.Hypothesis(*x) for _, k, x in found}
        if recall:
            s.history, s.earlier = [list(x) for x in self.past.get()], 0
        return s, keys

    def store(self, s: fold.State, before: dict[int, list[str]], recall: bool) -> None:
        if recall:
            self.past.clear()
        if s.history:
            self.past.appendList([tuple(x) for x in s.history])
        s.earlier += len(s.history)
        v = {n: getattr(s, n) for n in _SAME}
        v |= {"work_id": s.current and s.current.work_id, "line": s.current and s.current.line}
        v |= {"armed_id": s.armed and s.armed["work_id"], "armed_score": s.armed and float(s.armed["score"])}
        self.scalars.update(tuple(v[n] for n in _NAMES))
        held = {s.current.work_id: s.current.keys} if s.current else {}
        if s.armed:
            held.setdefault(s.armed["work_id"], s.armed["keys"])
        for k in before.keys() - held.keys():
            self.keys.removeKey((k,))
        for k, own in held.items():
            if before.get(k) != own:
                self.keys.updateValue((k,), (own,))
        for (k,) in list(self.hypotheses.keys()):
            if k not in s.hypotheses:
                self.hypotheses.removeKey((k,))
        for i, (k, h) in enumerate(s.hypotheses.items()):
            self.hypotheses.updateValue((k,), (i, h.line, float(h.score), float(h.total), h.seen, h.stability))

    def forget(self) -> None:
        for part in (self.scalars, self.hypotheses, self.keys, self.past):
            part.clear()
