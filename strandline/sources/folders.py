"""Folders that all machines share, and outputs that appear in them whole and once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.keep import released

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all is one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if "local" not in _local:
        _local["local"] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _local["local"]


#: Whether the shuffle files of a query go when it ends, instead of when the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that `make` gives, as Parquet at a new path, read from there. What lies on disk to make them, shuffle files and what is kept or shared with
    tasks, is removed at the end, so a job of several such steps has that of one step on disk at a time."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        with released():
            rows = make()
            rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)
    return spark.read.schema(rows.schema).parquet(path)


class Folder:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._class = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._class(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._class(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        where = self._class(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def rename(self, name: str, to: str) -> bool:
        """False if `to` is there already."""
        return not self.has(to) and self._fs.rename(self._at(name), self._at(to))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Write a small file of a new name; False, and nothing changed, if another writer has made it."""
        self._fs.mkdirs(self._class(self.path))
        if self.has(name):
            return False
        try:
            out = self._fs.create(self._at(name), False)
        except Exception:
            if self.has(name):  # made in between
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())


def commit_once(rows: DataFrame, path: str, name: str) -> bool:
    """Write rows as the folder `name` of `path`, which appears whole or not at all; False if it is there already.

    What runs again after a failure finds its own output and adds nothing. Attempts that failed leave folders that
    begin with `_`, which readers pass over. The folder's file system has to rename a folder in one step.
    """
    folder = Folder(rows.sparkSession, path)
    if folder.has(name):
        return False
    attempt = f"_attempt-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{attempt}")
    return folder.rename(attempt, name)
