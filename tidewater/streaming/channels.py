"""Append channels: fenced writers whose rows land as files and are taken into a table by a stream."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StaleToken(ValueError):
    """A token of a writer that a later one has replaced."""


@dataclass
class Channel:
    """What is known of a channel; its sequencer grows whenever it is opened."""

    sequencer: int = 0
    rows: int = 0
    errors: int = 0
    last_error: str | None = None
    offset: str | None = None
    appends: int = 0


#: An entry of a pipe's log: what happened to a channel, and for appended rows the folder that they landed in.
ENTRY = "at long, channel string, what string, sequencer int, offset string, rows long, error string, path string"


@dataclass
class Pipe:
    """A table that channels append to; a folder in a store that driver and executors share holds all of it.

    Rows land as Parquet in a folder of their own and count from the moment when the log names it. So the log fences
    stale writers, also those of another driver that opened the channel before, and an offset token that a channel has
    sent before is passed over. drain() streams the log's entries, of which there is one for each append, and adds what
    they name to the table; a repeated batch of the stream replaces itself.
    """

    spark: SparkSession
    folder: str
    schema: T.StructType
    lock: threading.RLock = field(default_factory=threading.RLock)

    def __post_init__(self) -> None:
        self.spark.createDataFrame([], ENTRY).write.mode("append").json(f"{self.folder}/log")

    def log(self) -> DataFrame:
        """All entries; `at` is their order."""
        return self.spark.read.schema(ENTRY).json(f"{self.folder}/log")

    def _note(self, channel: str, what: str, sequencer: int, offset: str | None = None, rows: int = 0, error: str | None = None, path: str | None = None) -> None:
        self.spark.createDataFrame([(time.time_ns(), channel, what, sequencer, offset, rows, error, path)], ENTRY).coalesce(1).write.mode("append").json(f"{self.folder}/log")

    def _sequencer(self, channel: str) -> int:
        return self.log().where(F.col("channel") == channel).agg(F.max("sequencer")).first()[0] or 0

    def open(self, name: str, offset: str | None = None) -> str:
        """A token for the channel; older tokens are stale from now on."""
        with self.lock:
            sequencer = self._sequencer(name) + 1
            self._note(name, "open", sequencer, offset)
            return f"{name}:{sequencer}"

    def append(self, token: str, rows: DataFrame | list[dict], offset: str | None = None) -> None:
        """Lands rows if the token is the channel's latest and the offset new. Columns that the schema lacks are left out,
        missing ones are null. Rows of a DataFrame are written by its tasks; a list is for a few rows."""
        name, _, sequencer = token.rpartition(":")
        with self.lock:
            if name not in self.status(name) or self._sequencer(name) != int(sequencer):
                raise StaleToken(token)
            sent = (F.col("channel") == name) & (F.col("what") == "append") & (F.col("offset") == offset)
            if offset is not None and not self.log().where(sent).isEmpty():
                return
            path = f"{self.folder}/landing/{uuid.uuid4().hex}"
            try:
                if isinstance(rows, list):
                    rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in self.schema) for r in rows], self.schema)
                rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(path)
                count = self.spark.read.schema(self.schema).parquet(path).count()
            except Exception as error:
                self._note(name, "error", int(sequencer), error=str(error)[:200], rows=len(rows) if isinstance(rows, list) else 1)
                raise
            self._note(name, "append", int(sequencer), offset, count, path=path)

    def channels(self) -> DataFrame:
        """channel, sequencer, rows, errors, last_error, offset and appends of every channel that isn't dropped."""
        is_append, is_error = F.col("what") == "append", F.col("what") == "error"
        alive = self.log().groupBy("channel").agg(
            F.max("sequencer").alias("sequencer"), F.sum(F.when(is_append, F.col("rows")).otherwise(0)).alias("rows"), F.sum(F.when(is_error, F.col("rows")).otherwise(0)).alias("errors"),
            F.max_by("error", F.when(is_error, F.col("at"))).alias("last_error"), F.max_by("offset", F.when(F.col("offset").isNotNull() & (is_append | (F.col("what") == "open")), F.col("at"))).alias("offset"),
            F.sum(is_append.cast("long")).alias("appends"), F.max_by("what", F.when(F.col("what").isin("open", "drop"), F.col("at"))).alias("last"),
        )
        return alive.where("last = 'open'").drop("last")

    def status(self, *names: str) -> dict[str, Channel]:
        """Of the channels that exist."""
        found = self.channels().where(F.col("channel").isin(*names)).collect()
        return {r.channel: Channel(r.sequencer, r.rows, r.errors, r.last_error, r.offset, r.appends) for r in found}

    def drop(self, name: str) -> None:
        """A channel that isn't there is a KeyError."""
        with self.lock:
            if name not in self.status(name):
                raise KeyError(name)
            self._note(name, "drop", self._sequencer(name))

    def drain(self) -> DataFrame:
        """Takes in all that has been appended since the last call, once each, and returns the table."""

        def take(entries: DataFrame, number: int) -> None:
            paths = [r.path for r in entries.where("what = 'append'").select("path").collect()]
            if paths:
                self.spark.read.schema(self.schema).parquet(*paths).write.mode("overwrite").parquet(f"{self.folder}/table/batch={number}")

        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/table/batch=-1")
        stream = self.spark.readStream.schema(ENTRY).json(f"{self.folder}/log").writeStream.foreachBatch(take)
        stream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/table").select(*self.schema.fieldNames())


def windowed_counts(events: DataFrame, at: str, length: str, *by: str, value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums for each window and key, over a stream or a table; windows tumble unless `slide` is shorter.

    In a stream whose result is appended, rows that come later than `late` behind the latest one are left out.
    """
    windows = events.withWatermark(at, late) if events.isStreaming else events
    return windows.groupBy(F.window(at, length, slide).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def run_to_table(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and returns its last result."""
    spark, schema = stream.sparkSession, stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result" if mode == "complete" else f"{folder}/result/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/result").select(*schema.fieldNames())
