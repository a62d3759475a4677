"""Connectors: service responses, devices, settings, commands, event and display sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

# Names fixed by the corpus service.
RESPONSE = (
    "struct<resultsInfo:struct<totalResults:int>,verses:array<struct<shabadId:bigint,verseId:bigint,pageNo:int,"
    "source:struct<sourceId:string>,verse:struct<unicode:string,gurmukhi:string>,"
    "translation:struct<en:struct<bdb:string>>>>>"
)


def response_rows(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """One row for each line of nested responses; a response with no results or that does not parse gives none."""
    parsed = df.select(key, F.from_json(column, RESPONSE).alias("r")).where("r.resultsInfo.totalResults > 0")
    v = parsed.select(key, F.explode("r.verses").alias("v"))
    text = lambda path: F.coalesce(F.col(path), F.lit(""))
    return v.select(
        key,
        F.coalesce("v.shabadId", F.lit(0)).cast("long").alias("work_id"),
        F.coalesce("v.verseId", F.lit(0)).cast("long").alias("line_id"),
        F.coalesce("v.source.sourceId", F.lit("G")).alias("source"),
        F.coalesce("v.pageNo", F.lit(0)).alias("page_no"),
        text("v.verse.unicode").alias("text"),
        text("v.verse.gurmukhi").alias("alt_text"),
        text("v.translation.en.bdb").alias("translation"),
    )


def input_devices(devices: DataFrame) -> DataFrame:
    """Devices (index, name, channels, default) that can record."""
    return devices.where("channels > 0").select("index", "name", "channels", "default")


def pick_device(devices: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The first device (idx, name) by the first of the wanted parts of its name, then by index."""
    rank: Column = F.lit(len(wanted))
    for i in reversed(range(len(wanted))):
        rank = F.when(F.contains(F.lower("name"), F.lit(wanted[i].lower())), i).otherwise(rank)
    return devices.orderBy(rank, "idx").limit(1)


def load_settings(path: str) -> dict:
    """Controller pin and confidence mode of a JSON file; what is missing or invalid takes its default."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        raw = {}
    pin = str(raw.get("controller_pin") or "").strip()
    return {"controller_pin": int(pin) if pin.isdigit() else None, "confidence_mode": C.profile(raw.get("confidence_mode")).name}


def save_settings(path: str, settings: dict) -> None:
    Path(path).write_text(json.dumps(settings, indent=2, ensure_ascii=False), encoding="utf-8")


COMMANDS = ("manual_select", "navigate", "recall", "pause", "resume", "set_controller_pin", "force_unlock", "set_confidence_mode")
COMMAND_SCHEMA = "type string, shabad_id bigint, direction string, controller_pin string, mode string"


def parse_commands(messages: DataFrame, column: str = "message") -> DataFrame:
    """Rows with (command, arg) of JSON messages, their other columns kept; messages of unknown types, or that do not parse, are dropped."""
    m = messages.withColumn("m", F.from_json(column, COMMAND_SCHEMA)).where(F.col("m.type").isin(*COMMANDS))
    arg = F.coalesce(F.col("m.shabad_id").cast("string"), "m.direction", "m.controller_pin", "m.mode")
    return m.select("*", F.col("m.type").alias("command"), arg.alias("arg")).drop("m")


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Windows as a stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def to_messages(events: DataFrame) -> DataFrame:
    """Events as JSON messages, one column `value`: what a fan-out sink sends."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def fan_out(send: Sequence[Callable[[list[str]], None]], delivered: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch's messages to all clients and drops clients that fail.

    A batch id that was delivered is not sent again, so a replayed batch does no harm. With a folder
    `delivered`, next to the stream's checkpoint, this holds after a restart too.
    """
    clients, done = list(send), set()
    read = False

    def known(spark: SparkSession) -> set:
        nonlocal read
        if delivered and not read:
            from pyspark.errors import AnalysisException

            try:
                done.update(r[0] for r in spark.read.schema("batch long").parquet(delivered).distinct().collect())
            except AnalysisException:  # nothing delivered yet
                pass
            read = True
        return done

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in known(spark):
            return
        # A display's batch is the few events of a moment; they are streamed through, not collected at once.
        for row in to_messages(batch).toLocalIterator():
            for client in list(clients):
                try:
                    client([row["value"]])
                except Exception:  # a client that is gone
                    clients.remove(client)
        done.add(batch_id)
        if delivered:
            spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(delivered)

    return deliver


def console(events: DataFrame) -> DataFrame:
    """What the console shows: transcriptions and errors."""
    return events.where(F.col("type").isin("transcription", "error"))


def display_payload(line_id: Column, first_id: Column, index: Column, pin: int | None = None) -> Column:
    """The command that shows a line; names fixed by the display."""
    fields = [
        F.lit("shabad").alias("type"), line_id.alias("verseId"), (index + 1).alias("lineCount"), first_id.alias("homeId"),
    ]
    if pin is not None:
        fields.append(F.lit(str(pin)).alias("pin"))
    return F.struct(*fields)


def write_index(lines: DataFrame, path: str) -> None:
    """Store keyed lines once, sorted by work in each file, so that lookups of a work skip row groups."""
    lines.repartition("work_id").sortWithinPartitions("work_id", "line_idx").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
