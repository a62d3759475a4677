"""Events to many clients: a sink that commits each epoch once, and subscriptions that follow what is committed.

The tasks of an epoch write its messages to files of their own; the commit names these files in a log, one entry an epoch,
created exclusively. An epoch that Spark runs again finds its entry and removes its second files, so it is delivered once; an
epoch that fails leaves no entry. No event passes through the driver. The folder is any that all machines share.

    spark.dataSource.register(FanOut)
    events.writeStream.format("fan_out").option("path", folder)...

A `Subscription` is one client's view of the log, in any process: it sends the messages of committed epochs in order, keeps how far it
is, and when its client fails it lets go of it and connects anew after `retry` seconds, going on with the message that
failed. One client's failure does not hold up another.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

RETRY = 3.0


class Log:
    """Entries of epochs and files of messages in a folder."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path if urlsplit(path).scheme else "file://" + path)

    def write(self, name: str, lines: list[str]) -> None:
        where = f"{self.path}/{name}"
        self.fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(where, compression=None) as out:
            out.write("".join(x + "\n" for x in lines).encode())

    def lines(self, name: str) -> list[str]:
        with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            return f.read().decode().splitlines()

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))

    def remove(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete_file(f"{self.path}/{name}")

    def enter(self, epoch: int, files: list[str]) -> bool:
        """Commit an epoch; False if it is committed already. One query commits at a time; the entry appears whole."""
        name = f"{epoch:019d}"
        if name in self.names("log"):
            return False
        self.write(f"log/.{name}", files)
        self.fs.move(f"{self.path}/log/.{name}", f"{self.path}/log/{name}")
        return True


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class FanOut(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fan_out"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"], schema.fieldNames())


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator: Iterator) -> Written:
        """One task's messages: `value` as it is, or whole rows as JSON."""
        lines = [r["value"] if self.names == ["value"] else json.dumps(r.asDict(True), ensure_ascii=False, default=str) for r in iterator]
        if not lines:
            return Written(None)
        name = f"messages/{uuid.uuid4().hex}"
        Log(self.path).write(name, lines)
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        # Tasks in their order; the order within a session is that of its task.
        files = [m.file for m in messages if m and m.file]
        log = Log(self.path)
        if not log.enter(batchId, files):
            log.remove(files)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Log(self.path).remove([m.file for m in messages if m and m.file])


class Subscription:
    """A client of the log. `connect()` gives a function that sends one message, and raises when the client is away."""

    def __init__(self, path: str, client: str, connect: Callable[[], Callable[[str], None]], retry: float = RETRY, clock: Callable[[], float] = time.monotonic):
        self.log, self.client, self.connect, self.retry, self.clock = Log(path), client, connect, retry, clock
        self.send: Callable[[str], None] | None = None
        self.not_before = 0.0
        self.epoch, self.sent = self._read()

    def _read(self) -> tuple[int, int]:
        if self.client in self.log.names("clients"):
            epoch, sent = self.log.lines(f"clients/{self.client}")[0].split()
            return int(epoch), int(sent)
        return -1, 0

    def _keep(self) -> None:
        self.log.write(f"clients/.{self.client}", [f"{self.epoch} {self.sent}"])
        self.log.fs.move(f"{self.log.path}/clients/.{self.client}", f"{self.log.path}/clients/{self.client}")

    def poll(self) -> int:
        """Send what is new; how many messages. Does nothing while the client is to be left alone."""
        if self.clock() < self.not_before:
            return 0
        n = 0
        try:
            self.send = self.send or self.connect()
            for name in self.log.names("log"):
                if int(name) <= self.epoch:
                    continue
                lines = [x for f in self.log.lines(f"log/{name}") for x in self.log.lines(f)]
                for line in lines[self.sent :]:
                    self.send(line)
                    self.sent, n = self.sent + 1, n + 1
                self.epoch, self.sent = int(name), 0
                self._keep()
        except Exception:  # the client is gone
            self.send, self.not_before = None, self.clock() + self.retry
            if self.sent:
                self._keep()
        return n


def follow(subscriptions: list[Subscription], until: Callable[[], bool], pause: float = 0.2) -> None:
    """Serve clients in turn until told to stop."""
    while not until():
        if not sum(s.poll() for s in subscriptions):
            time.sleep(pause)
